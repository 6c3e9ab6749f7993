"""One consistent form for text that looks the same.

Every character is brought to its prototype: width, ligature and font variants
to plain letters, accents apart from their letters, blanks to the blank, what
cannot be seen to nothing, look-alikes of other alphabets to one letter. Per
token the sets of scripts that could write each letter are intersected: one
script left is the token's script, several make it a whole-script confusable,
which takes the script most of the page's other tokens settle on, none left
leaves it mixed, in prototypes. The token is then spelled in its script and
accents are joined to their letters again.

The form depends on the prototypes alone, so two texts look the same exactly
when their forms are equal.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specstrata.session import materialize, table

# Letters of other alphabets that the public list of confusable characters joins to a Latin letter and that are drawn like it, letter by letter.
LOOKALIKES = {
    "CYRILLIC": ("АВЕЅІЈКМНОРСТХҮԚԜӀԌѴасеһіјӏорԛѕѵԝхуԁ", "ABESIJKMHOPCTXYQWIGVacehijlopqsvwxyd"),
    "GREEK": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿοϲϳνρ", "ABEZHIKMNOPTYXCJocjvp"),
    "ARMENIAN": ("ՕՍՏօհոսցզ", "OUSohnugq"),
    "CHEROKEE": ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏢᏟᏒᏚᏙᏞᏦᏴ", "DRTAJEWMHGZPCRSVLKB"),
    "LISU": ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    "COPTIC": ("ⲀⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "ABHIKMNOPCTYXopc"),
    "DESERET": ("𐐄𐐕𐐛𐐬𐐽", "OCLoc"),
    "TIFINAGH": ("ⴹⵔⵝ", "EOX"),
    "LATIN": ("ɡᴄᴏᴠᴡᴢꜱ", "gcovwzs"),
}
# Signs drawn like another sign.
SIGNS = {"‐": "-", "‑": "-", "⁃": "-", "∶": ":", "։": ":", "⁄": "/", "∕": "/", "∣": "|", "ǀ": "|", "‧": "·", "∙": "·", "⋅": "·", "‚": ",", "ʼ": "’", "․": "."}
SCRIPTS = ("LATIN", *(script for script in LOOKALIKES if script != "LATIN"))
VARIANTS = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}
LINE_ENDS = regex.compile("\r\n|[\r\x0b\x0c\x85  ]")
KEPT = 200_000

_unseen = regex.compile(r"\p{Default_Ignorable_Code_Point}|[\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f]")
_prototype = {a: b for ours, theirs in LOOKALIKES.values() for a, b in zip(ours, theirs)}
_written = {script: dict(zip(theirs[::-1], ours[::-1])) for script, (ours, theirs) in LOOKALIKES.items() if script != "LATIN"}
_writers = {letter: frozenset(["LATIN", *(s for s, w in _written.items() if letter in w)]) for w in _written.values() for letter in w}


class _Prototypes(dict):
    """Code point -> its prototype text; for str.translate."""

    def __missing__(self, code: int) -> str:
        self[code] = out = self.prototype(chr(code))
        return out

    def prototype(self, ch: str) -> str:
        if _unseen.fullmatch(ch):
            return ""
        if ch == "\t" or unicodedata.category(ch) == "Zs":
            return " "
        if ch in SIGNS:
            return SIGNS[ch]
        tag, _, codes = unicodedata.decomposition(ch).rpartition(">")
        parts = [chr(int(x, 16)) for x in codes.split()]
        if parts and (not tag or tag + ">" in VARIANTS or tag == "<compat" and self.same_look(ch, parts)):
            return "".join(self[ord(x)] for x in parts)
        return _prototype.get(ch, ch)

    @staticmethod
    def same_look(ch: str, parts: list[str]) -> bool:
        """Whether a compatibility character is drawn like its parts."""
        name = unicodedata.name(ch, "")
        if " " in parts:
            return False
        return any(x in name for x in ("LIGATURE", "ROMAN NUMERAL", "MICRO SIGN", "DOT LEADER", "ELLIPSIS")) or name.startswith("LATIN") and "LONG S" not in name and "HALF RING" not in name


_prototypes = _Prototypes()


class _ScriptBits(dict):
    """Prototype letter -> bits of the scripts in which it can be written; all bits for signs, digits and accents."""

    def __init__(self) -> None:
        super().__init__()
        self.names = list(SCRIPTS)

    def __missing__(self, ch: str) -> int:
        if ch in _writers:
            bits = sum(1 << self.names.index(s) for s in _writers[ch])
        elif not ch.isalpha() or unicodedata.category(ch) == "Lm":
            bits = -1
        else:
            name = unicodedata.name(ch, "UNKNOWN").split()[0]
            if name not in self.names:
                self.names.append(name)
            bits = 1 << self.names.index(name)
        self[ch] = bits
        return bits


_bits = _ScriptBits()


def resolve(token: str) -> int:
    """Bits of the scripts in which the whole token (in prototypes) can be written: 0 if it mixes them, -1 if it holds no letter."""
    found = -1
    for ch in token:
        found &= _bits[ch]
    return found


def spell(token: str, script: str) -> str:
    """A token in prototypes written in ``script``."""
    letters = _written.get(script)
    if letters:
        token = "".join([letters.get(ch, ch) for ch in token])
    return token if token.isascii() else unicodedata.normalize("NFC", token)


_OPEN = "\x01"  # marks a token whose script the page decides; no prototype holds it
_open_token = regex.compile("\x01([^ \n]*)")
_FIELD = 40  # bits of each tally: more tokens than memory holds
_TALLIES = (*SCRIPTS, "OTHER", "MIXED", "OPEN")
_OTHER, _MIXED, _SEVERAL = range(len(SCRIPTS), len(_TALLIES))
# the tallies most texts have come first, so that their sums are short numbers
_SHIFT = [0] * len(_TALLIES)
for _place, _k in enumerate((0, _SEVERAL, _MIXED, *range(1, _MIXED))):
    _SHIFT[_k] = _FIELD * _place


class _Tallies(dict):
    """Chunk between plain blanks -> how many of its tokens settle on each script, stay mixed or could be of several scripts, as fields of one integer."""

    def __missing__(self, chunk: str) -> int:
        return _analyse(chunk)[1]


class _Forms(dict):
    """Chunk between plain blanks -> its form, tokens that the page decides being marked and in prototypes."""

    def __init__(self) -> None:
        super().__init__()
        self.tallies = _Tallies()

    def __missing__(self, chunk: str) -> str:
        form, tally = _analyse(chunk)
        if len(self) >= KEPT:
            self.clear()
            self.tallies.clear()
        if len(chunk) < 64:
            self[chunk] = form
            self.tallies[chunk] = tally
        return form


def _analyse(chunk: str) -> tuple[str, int]:
    if chunk == "\n":
        return chunk, 0
    plain = chunk.translate(_prototypes)
    if not plain.isascii():
        plain = unicodedata.normalize("NFD", plain)
    out, tally = [], 0
    for token in plain.split(" "):
        bits = resolve(token)
        if bits == -1:
            out.append(spell(token, "LATIN"))
        elif bits & (bits - 1):
            tally += 1 << _SHIFT[_SEVERAL]
            out.append(_OPEN + token)
        elif not bits:
            tally += 1 << _SHIFT[_MIXED]
            out.append(spell(token, "LATIN"))
        else:
            k = min(bits.bit_length() - 1, _OTHER)
            tally += 1 << _SHIFT[k]
            out.append(spell(token, _TALLIES[k]))
    return " ".join(out), tally


def _count(tally: int, k: int) -> int:
    return tally >> _SHIFT[k] & (1 << _FIELD) - 1


def page_script(tally: int) -> str:
    """The script most tokens settle on; the first of SCRIPTS in a tie, LATIN if none does."""
    counts = [_count(tally, k) for k in range(_MIXED)]
    return _TALLIES[counts.index(max(counts))]


def consistent_form(text: str, forms: _Forms | None = None) -> tuple[str, str, int, int]:
    """The consistent form of a text, its script, the number of tokens left mixed, and of those several scripts could write.

    Blanks at the end of a line cannot be seen and drop out.
    """
    forms = _Forms() if forms is None else forms
    chunks = LINE_ENDS.sub("\n", text).replace("\n", " \n ").split(" ")
    out = " ".join(map(forms.__getitem__, chunks)).replace(" \n ", "\n")
    tally = sum(map(forms.tallies.__getitem__, chunks))
    script = page_script(tally)
    if _OPEN in out:
        if script == "LATIN":
            out = out.replace(_OPEN, "")
            out = out if out.isascii() else unicodedata.normalize("NFC", out)
        else:

            def choose(found: regex.Match) -> str:
                bits = resolve(found[1])
                return spell(found[1], script if script in SCRIPTS and bits >> SCRIPTS.index(script) & 1 else SCRIPTS[(bits & -bits).bit_length() - 1])

            out = _open_token.sub(choose, out)
    if " \n" in out or out.endswith(" "):
        out = "\n".join([line.rstrip(" ") for line in out.split("\n")])
    return out, script, _count(tally, _MIXED), _count(tally, _SEVERAL)


def forms(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, form, script, n_mixed, n_confusable and changed of every document; a null text has null in all of them.

    n_mixed counts the tokens no one script can write, n_confusable the
    whole-script confusables, tokens that several scripts can.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Forms()
        for pdf in batches:
            rows = [(None, None, None, None, None) if t is None else (*(r := consistent_form(t, known)), r[0] != t) for t in pdf["_text"]]
            out = pd.DataFrame(rows, columns=["form", "script", "n_mixed", "n_confusable", "changed"]).astype({"n_mixed": "Int64", "n_confusable": "Int64", "changed": "boolean"})
            out.insert(0, "doc_id", pdf["_id"].to_numpy())
            yield out

    return documents.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")).where("_id is not null").mapInPandas(scan, "doc_id long, form string, script string, n_mixed long, n_confusable long, changed boolean")


def digests(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id with 128-bit digests of the form and of the text itself, of every document whose text is not empty."""

    def digest(s: str) -> bytes:
        return blake2b(s.encode(), digest_size=16).digest()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Forms()
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["_id"], "form": [digest(consistent_form(t, known)[0]) for t in pdf["_text"]], "own": [digest(t) for t in pdf["_text"]]})

    return documents.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")).where("_id is not null and _text <> ''").mapInPandas(scan, "doc_id long, form binary, own binary")


def same_looking_pairs(digested: DataFrame) -> DataFrame:
    """Pairs of documents of one form and different texts, smaller id first.

    Spellings are paired, not documents, so copies meet only the documents of
    other spellings they form pairs with.
    """
    digested = materialize(digested)
    spellings = digested.select("form", "own").distinct()
    shared = spellings.groupBy("form").agg(F.count("*").alias("n")).where("n > 1").select("form")
    kept = materialize(digested.distinct().join(shared, "form"))
    spelled = kept.select("form", "own").distinct()
    two = spelled.select("form", F.col("own").alias("own_a")).join(spelled.select("form", F.col("own").alias("own_b")), "form").where("own_a < own_b")
    a = kept.select(F.col("own").alias("own_a"), F.col("doc_id").alias("_a"))
    b = kept.select(F.col("own").alias("own_b"), F.col("doc_id").alias("_b"))
    return two.drop("form").join(a, "own_a").join(b, "own_b").select(F.least("_a", "_b").alias("doc_id_a"), F.greatest("_a", "_b").alias("doc_id_b"))


def p9_found(spark, sf_dir: str) -> DataFrame:
    return same_looking_pairs(digests(table(spark, sf_dir, "documents")))


def look_classes(digested: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its look), n_docs and n_spellings of the class; copies need no pairs."""
    digested = materialize(digested)
    spellings = digested.groupBy("form", "own").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    classes = spellings.groupBy("form").agg(F.min("first").alias("class_id"), F.sum("n").alias("n_docs"), F.count("*").alias("n_spellings"))
    return digested.join(classes, "form").select("doc_id", "class_id", "n_docs", "n_spellings")


def p9_classes(spark, sf_dir: str) -> DataFrame:
    """The class of pages that look the same to which each page with text belongs."""
    return look_classes(digests(table(spark, sf_dir, "documents")))


def p9_forms(spark, sf_dir: str) -> DataFrame:
    """The consistent form of every text."""
    return forms(table(spark, sf_dir, "documents"))
