"""Schemas that drift between files.

Every record gives the leaves it holds with their JSON types; the schemas of
records fuse, in parallel and map-side combined, into one tagged union per
file and path: the set of alternative types seen. Consecutive files of a feed
are compared on these unions. Paths that go and come in the same step are
then compared on the records, definitions and headings both files share, by
order-free digests of all their values, to tell a renamed field from one
removed and one added.

Nothing is grouped by feed alone: schemas are grouped by file and path,
values by file pair and item, so a feed that holds a third of all rows does
no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specstrata.functions.jsontext import clean, read_json, write_json
from specstrata.session import materialize, table

#: Bit of each JSON type in a tagged union.
TYPE_BITS = {"string": 1, "number": 2, "boolean": 4, "array": 8}


def type_bit(value: Any) -> int:
    """The bit of a leaf's JSON type; null has none."""
    if value is None:
        return 0
    if isinstance(value, bool):
        return TYPE_BITS["boolean"]
    if isinstance(value, (int, float)):
        return TYPE_BITS["number"]
    return TYPE_BITS["string"] if isinstance(value, str) else TYPE_BITS["array"]


def leaves(value: Any) -> Iterator[tuple[str, str, Any]]:
    """(path, item, leaf value) in document order; items are the record ("") and the objects of its arrays, by array and id.

    An object of an array without an id takes its place in the array for one.
    An array that holds an object or array is no leaf.
    """
    todo: list[tuple[Any, str, str]] = [(value, "", "")]
    while todo:
        value, path, item = todo.pop()
        if isinstance(value, dict):
            todo += [(x, f"{path}.{name}" if path else name, item) for name, x in reversed(value.items())]
        elif isinstance(value, list) and any(isinstance(x, (dict, list)) for x in value):
            inner = []
            for k, x in enumerate(value):
                own = x.get("id") if isinstance(x, dict) else None
                inner.append((x, path, f"{item}|{path}={write_json(own if own is not None else [k])}" if isinstance(x, dict) else item))
            todo += reversed(inner)
        else:
            yield path, item, value


def canonical(value: Any) -> str:
    """A leaf as JSON text, equal for equal values; 1 and 1.0 are equal."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 1 << 53:
        value = int(value)
    return clean(write_json(value, ensure_ascii=False, sort_keys=True, comma=",", colon=":"))


def file_schemas(files: DataFrame) -> DataFrame:
    """feed, seq, path, kinds (the bits of the types seen) of every path a file holds non-null, and a row with path null per file."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: dict[tuple, int] = {}
            for feed, seq, text in zip(pdf["feed"], pdf["seq"], pdf["payload"]):
                seen[feed, seq, None] = 0
                value = read_json(text)
                if isinstance(value, dict):
                    for path, _, leaf in leaves(value):
                        if leaf is not None:
                            at = (feed, seq, path)
                            seen[at] = seen.get(at, 0) | type_bit(leaf)
            yield pd.DataFrame([(*k[:2], None if k[2] is None else clean(k[2]), bits) for k, bits in seen.items()], columns=["feed", "seq", "path", "kinds"])

    rows = files.select("feed", F.col("seq").cast("int").alias("seq"), "payload").where("feed is not null and seq is not null")
    return rows.mapInPandas(scan, "feed string, seq int, path string, kinds int").groupBy("feed", "seq", "path").agg(F.bit_or("kinds").alias("kinds"))


def file_steps(schemas: DataFrame) -> DataFrame:
    """feed, seq, before: every file with the one before it. A feed's files are numbered, so a window over them is as small as its history."""
    of_feed = Window.partitionBy("feed").orderBy("seq")
    return schemas.where("path is null").select("feed", "seq").withColumn("before", F.lag("seq").over(of_feed)).where("before is not null")


def schema_changes(files: DataFrame) -> DataFrame:
    """Added, removed and retyped paths before renames are told: feed, seq, before, path, k_before, k_now, change_kind."""
    schemas = materialize(file_schemas(files))
    steps = materialize(file_steps(schemas))
    held = schemas.where("path is not null")
    now = steps.join(held, ["feed", "seq"]).select("feed", "seq", "before", "path", F.col("kinds").alias("k_now"), F.lit(None).cast("int").alias("k_before"))
    past = steps.join(held.withColumnRenamed("seq", "before"), ["feed", "before"]).select("feed", "seq", "before", "path", F.lit(None).cast("int").alias("k_now"), F.col("kinds").alias("k_before"))
    both = now.unionByName(past).groupBy("feed", "seq", "before", "path").agg(F.max("k_now").alias("k_now"), F.max("k_before").alias("k_before"))
    kind = F.when(F.col("k_before").isNull(), "added").when(F.col("k_now").isNull(), "removed").when(F.col("k_now") != F.col("k_before"), "retyped")
    return both.withColumn("change_kind", kind).where("change_kind is not null")


def renames(files: DataFrame, changes: DataFrame) -> DataFrame:
    """feed, seq, old_path, new_path of fields that go and come with the same values.

    The values of both must agree, null for null, on every item the two files
    share, and at least one must be there. So both fields have one digest, an
    order-free sum over the items, and partners are found by equality of
    digests. Where several fields have one digest they are partnered in the
    order of their names, each at most once.
    """
    side = changes.where("change_kind in ('added', 'removed')").select("feed", "seq", "before", "path", (F.col("change_kind") == "added").alias("late"))
    paths = side.groupBy("feed", "seq", "before").agg(F.collect_set(F.when(~F.col("late"), F.col("path"))).alias("gone"), F.collect_set(F.when(F.col("late"), F.col("path"))).alias("come"))  # no more than a file has fields
    steps = materialize(paths.where("size(gone) > 0 and size(come) > 0"))
    wanted = steps.select("feed", F.col("seq").alias("file_seq"), F.col("seq").alias("step"), F.lit(True).alias("late"), F.col("come").alias("paths")).unionByName(
        steps.select("feed", F.col("before").alias("file_seq"), F.col("seq").alias("step"), F.lit(False).alias("late"), F.col("gone").alias("paths"))
    )
    rows = files.select("feed", F.col("seq").cast("int").alias("file_seq"), "payload").where("payload is not null").join(wanted, ["feed", "file_seq"])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: dict[tuple, None] = {}
            for feed, step, late, paths, text in zip(pdf["feed"], pdf["step"], pdf["late"], pdf["paths"], pdf["payload"]):
                value = read_json(text)
                if not isinstance(value, dict):
                    continue
                url = write_json(value.get("url"))
                wanted_paths = set(paths)
                items: dict[str, bytes] = {}
                for path, item, leaf in leaves(value):
                    if item not in items:
                        items[item] = _hash(f"{url}{item}")
                        out[feed, step, late, items[item], None, None] = None
                    name = clean(path)
                    if leaf is not None and name in wanted_paths:
                        out[feed, step, late, items[item], name, _hash(canonical(leaf))] = None
            yield pd.DataFrame(list(out), columns=["feed", "step", "late", "item", "path", "val"])

    values = rows.mapInPandas(scan, "feed string, step int, late boolean, item binary, path string, val binary")
    held = F.struct("late", "path", "val")
    item = values.groupBy("feed", "step", "item").agg(F.max("late").alias("in_new"), F.min("late").alias("only_new"), F.collect_set(F.when(F.col("path").isNotNull(), held)).alias("held"))
    shared = item.where("in_new and not only_new").select("feed", "step", "item", F.explode("held").alias("h")).select("feed", "step", "item", "h.late", "h.path", "h.val")
    digest = [F.bit_xor(F.xxhash64(F.lit(salt), "item", "val")).alias(f"d{salt}") for salt in (1, 2)]
    digests = materialize(shared.groupBy("feed", "step", "late", "path").agg(F.count("*").alias("n"), *digest))
    alike = ["feed", "step", "n", "d1", "d2"]
    ranked = digests.withColumn("k", F.row_number().over(Window.partitionBy(*alike, "late").orderBy("path")))
    old, new = (ranked.where(late).select(*alike, "k", F.col("path").alias(name)) for late, name in ((~F.col("late"), "old_path"), (F.col("late"), "new_path")))
    return old.join(new, [*alike, "k"]).select("feed", F.col("step").alias("seq"), "old_path", "new_path")


def _hash(text: str) -> bytes:
    return blake2b(text.encode(), digest_size=16).digest()


def drift(files: DataFrame) -> DataFrame:
    """Every change between a file and the next of its feed: feed, seq, field_path, change_kind, old_path, k_before, k_now.

    k_before and k_now are the alternatives of the field in the two files, as
    bits of TYPE_BITS; of a renamed field those under its old and new name.
    Unreadable payloads and records that are no objects hold no field. A file
    with none is empty, not absent. Copies of a record change nothing.
    """
    changes = materialize(schema_changes(files))
    renamed = materialize(renames(files, changes))
    spent = renamed.select("feed", "seq", F.col("old_path").alias("path"), F.lit("removed").alias("change_kind"), F.col("new_path")).unionByName(renamed.select("feed", "seq", F.col("new_path").alias("path"), F.lit("added").alias("change_kind"), F.col("new_path")))
    told = changes.join(spent, ["feed", "seq", "path", "change_kind"], "left")
    plain = told.where("new_path is null").select("feed", "seq", F.col("path").alias("field_path"), "change_kind", F.lit(None).cast("string").alias("old_path"), "k_before", "k_now")
    linked = told.where("new_path is not null").groupBy("feed", "seq", F.col("new_path").alias("field_path")).agg(
        F.lit("renamed").alias("change_kind"), F.max(F.when(F.col("change_kind") == "removed", F.col("path"))).alias("old_path"), F.max("k_before").alias("k_before"), F.max("k_now").alias("k_now")
    )
    return plain.unionByName(linked)


def p6_found(spark, sf_dir: str) -> DataFrame:
    return drift(table(spark, sf_dir, "extract_files")).select("feed", "seq", "field_path", "change_kind")


def kind_names(bits: Column) -> Column:
    """The names of the types in a tagged union, joined by a bar; null for none."""
    return F.when(bits > 0, F.array_join(F.array_compact(F.array(*[F.when(bits.bitwiseAND(F.lit(b)) > 0, F.lit(name)) for name, b in TYPE_BITS.items()])), "|"))


def p6_changes(spark, sf_dir: str) -> DataFrame:
    """Every change with the field's alternatives before and after it, and those that appeared and went."""
    before, now = F.coalesce("k_before", F.lit(0)), F.coalesce("k_now", F.lit(0))
    changes = drift(table(spark, sf_dir, "extract_files"))
    return changes.select(
        "feed", "seq", "field_path", "change_kind", "old_path", kind_names(before).alias("types_before"), kind_names(now).alias("types_now"),
        kind_names(now.bitwiseAND(F.bitwise_not(before))).alias("types_come"), kind_names(before.bitwiseAND(F.bitwise_not(now))).alias("types_gone"),
    )


def field_spans(changes: DataFrame) -> DataFrame:
    """feed, path, from_seq, to_seq, field_name: the field each path stands for, from one file up to before another (null: for good), where it is not always the field of that name.

    A field keeps its first name through renames. A path that is given up in a
    rename and comes again is another field, unless it comes by a rename too;
    a path that is removed and comes again is the field it was. A new field
    whose name an older one has taken is called by its name and first file,
    as in ``a@5``. The history of a feed is as long as it has files, whatever
    their sizes, and is read in one go.
    """

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["change_kind"] != "retyped"].sort_values(["seq", "field_path"])
        touched = {p for k in ("field_path", "old_path") for p in pdf.loc[pdf["change_kind"] == "renamed", k]}
        current: dict[str, tuple[str, int | None]] = {}  # path -> field and the file from which it has it
        dormant: dict[str, str] = {}
        names: set[str] = set()
        spans = []

        def name_for(path: str, seq: int | None) -> str:
            name = path if path not in names else f"{path}@{seq}"
            names.add(name)
            return name

        def end(path: str, seq: int) -> str:
            name, begun = current.pop(path) if path in current else (name_for(path, None), None)
            spans.append((path, begun, seq, name))
            return name

        begun_with: set[str] = set()  # paths there from the feed's first file: those whose first change takes them away
        met: dict[str, int] = {}
        for r in pdf.itertuples():
            for p, goes in ((r.field_path, r.change_kind == "removed"), (r.old_path, True)):
                if p in touched and met.setdefault(p, r.seq) == r.seq and goes:
                    begun_with.add(p)
        for p in sorted(begun_with):
            current[p] = (name_for(p, None), None)
        for seq, step in pdf[pdf["field_path"].isin(touched) | pdf["old_path"].isin(touched)].groupby("seq", sort=True):
            moved = [(r.field_path, end(r.old_path, seq)) for r in step.itertuples() if r.change_kind == "renamed"]
            for r in step.itertuples():
                if r.change_kind == "removed":
                    dormant[r.field_path] = end(r.field_path, seq)
            for path, name in moved:
                current[path] = (name, seq)
                dormant.pop(path, None)
            for r in step.itertuples():
                if r.change_kind == "added":
                    current[r.field_path] = (dormant.pop(r.field_path, None) or name_for(r.field_path, seq), seq)
        spans += [(path, begun, None, name) for path, (name, begun) in current.items()]
        out = pd.DataFrame([(pdf["feed"].iloc[0], *s) for s in spans if s[3] != s[0]], columns=["feed", "path", "from_seq", "to_seq", "field_name"])
        return out.astype({"from_seq": "Int32", "to_seq": "Int32"})

    of_feed = changes.where("change_kind = 'renamed'").select("feed").distinct()
    history = changes.select("feed", "seq", "field_path", "old_path", "change_kind").join(of_feed, "feed", "left_semi")
    return history.groupBy("feed").applyInPandas(lambda pdf: follow(pdf), "feed string, path string, from_seq int, to_seq int, field_name string")


def consistent_table(files: DataFrame) -> DataFrame:
    """The consistent table of all files in long form: one row per record, item and field, by the name of ``field_spans``.

    Typed branches hold the value in its own type (val_text; val_number, with
    val_integer where it is one of 64 bits; val_flag; val_list as JSON) and
    val_text_form is the canonical conversion every branch can be compared in:
    texts as they are, all else as JSON text, a list of one as its item.
    """
    spans = materialize(field_spans(drift(files)))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["row_no", "feed", "seq", "item", "path", "val_text", "val_number", "val_integer", "val_flag", "val_list", "val_text_form"]

        def frame(out: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(out, columns=columns, dtype=object).astype({"row_no": "int64", "seq": "Int32", "val_number": "float64", "val_integer": "Int64", "val_flag": "boolean"})

        out: list[tuple] = []
        for pdf in batches:
            for row_no, feed, seq, text in zip(pdf["row_no"], pdf["feed"], pdf["seq"], pdf["payload"]):
                value = read_json(text)
                if not isinstance(value, dict):
                    continue
                for path, item, leaf in leaves(value):
                    bit = type_bit(leaf)
                    if bit:
                        one = leaf[0] if isinstance(leaf, list) and len(leaf) == 1 else leaf
                        form = clean(one) if isinstance(one, str) else canonical(one)
                        number, whole = (_double(leaf), int(leaf) if -(1 << 63) <= leaf < 1 << 63 and leaf == int(leaf) else None) if bit == 2 else (None, None)
                        out.append((row_no, feed, seq, clean(item), clean(path), clean(leaf) if bit == 1 else None, number, whole, leaf if bit == 4 else None, canonical(leaf) if bit == 8 else None, form))
                if len(out) >= 20_000:
                    yield frame(out)
                    out = []
        yield frame(out)

    once = files.select("row_no", "feed", F.col("seq").cast("int").alias("seq"), "payload").where("row_no is not null and feed is not null").distinct()
    rows = once.mapInPandas(
        scan, "row_no long, feed string, seq int, item string, path string, val_text string, val_number double, val_integer long, val_flag boolean, val_list string, val_text_form string"
    )
    at = [rows["feed"] == spans["feed"], rows["path"] == spans["path"], F.coalesce(rows["seq"] >= spans["from_seq"], spans["from_seq"].isNull()), F.coalesce(rows["seq"] < spans["to_seq"], spans["to_seq"].isNull())]
    named = rows.join(spans, at[0] & at[1] & at[2] & at[3], "left")
    return named.select(*[rows[c] for c in rows.columns if c != "path"], F.coalesce(spans["field_name"], rows["path"]).alias("field_path"))


def p6_fields(spark, sf_dir: str) -> DataFrame:
    """``consistent_table`` of all extract files, flags as 1 and 0."""
    return consistent_table(table(spark, sf_dir, "extract_files")).withColumn("val_flag", F.col("val_flag").cast("int"))


def _double(number: int | float) -> float:
    try:
        return float(number)
    except OverflowError:
        return float("inf") if number > 0 else float("-inf")
