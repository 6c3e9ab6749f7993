import random
import unicodedata

from specstrata.llm import lookalikes as L
from specstrata.llm.lookalikes import consistent_form, digests, forms, look_classes, p9_found, same_looking_pairs


def form(text):
    return consistent_form(text)[0]


def test_same_look():
    groups = [
        ["Peace café fi, so.", "Реасе café ﬁ, ѕо.", "Ｐｅａｃｅ café fi， so．", "Pe​ace café fi, s­o.", "Peace café fi, ѕо.  "],
        ["Слово сор", "Cлoвo cop", "Слово ѕ".replace("ѕ", "сор")],
        ["Ομικρον ο", "Oμικρoν o", "Οµικρον ο"],
        ["a\nb", "a\r\nb", "a \nb", "а b"],
        ["ứa", "ứa", "ứa", "ứa"],
        ["well-known", "well‐known", "well‑known", "well－known"],
        ["Kelvin", "Kelvin"],
    ]
    for group in groups:
        assert len({form(t) for t in group}) == 1, [form(t) for t in group]
    assert len({form(g[0]) for g in groups}) == len(groups)


def test_other_look():
    for a, b in [("cafe", "café"), ("Cafe", "cafe"), ("a b", "ab"), ("a\nb", "a b"), ("x2", "x²"), ("l", "1"), ("rn", "m"), ("O", "0"), ("и", "u"), ("ö", "o"), ("a  b", "a b"), ("ſo", "so"), ("№", "No"), ("-", "–"), ("fi´", "fi ")]:
        assert form(a) != form(b), (a, b)


def test_listed_letters_are_told_by_their_script():
    for script, (ours, theirs) in L.LOOKALIKES.items():
        assert len(ours) == len(theirs) and all(unicodedata.name(c).split()[0] == script for c in ours), script


def test_recall_on_a_labelled_sample():
    """Words of a page, each letter swapped at random for one drawn alike; and words with a letter visibly changed."""
    rng = random.Random(11)
    swaps = {}
    for ours, theirs in L.LOOKALIKES.values():
        for a, b in zip(ours, theirs):
            swaps.setdefault(b, []).append(a)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hits = misses = 0
    for _ in range(500):
        words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(6)]
        other = ["".join(rng.choice(swaps[c]) if c in swaps and rng.random() < 0.5 else c for c in w) for w in words]
        hits += form(" ".join(words)) == form(" ".join(other))
        k = rng.randrange(6)
        changed = words[:k] + [rng.choice([c for c in letters if c != words[k][0]]) + words[k][1:]] + words[k + 1 :]
        misses += form(" ".join(words)) == form(" ".join(changed))
    assert hits == 500 and misses == 0


def test_tallies_of_long_texts():
    out = consistent_form("слово " * 70_000 + "word " * 69_999 + "сор " * 5)
    assert out[1] == "CYRILLIC" and out[2:] == (0, 5)
    assert L._count((1 << 39) << L._SHIFT[2], 2) == 1 << 39 and L.page_script(((1 << 39) << L._SHIFT[1]) + 3) == "CYRILLIC"


def test_script_of_the_page_decides():
    assert form("Слово cop") == "Слово сор" and form("word сор") == "word cop" and form("сор") == "cop"
    assert consistent_form("Слово Rжd")[2] == 1 and consistent_form("日本 сор")[0] == "日本 cop"
    assert form("Ηocmanbá") == "Hocmanbá" and form("") == "" and form("​") == ""


def test_form_is_stable_and_depends_on_the_look_only(monkeypatch):
    monkeypatch.setattr(L, "KEPT", 3)
    rng = random.Random(7)
    words = ["peace", "сорока", "λόγος", "word", "ſt", "café", "օ", "X1", "…", "日本", "ô̌", "naïve", "Ծա", "a b", ""]
    swap = {b: a for ours, theirs in L.LOOKALIKES.values() for a, b in zip(ours, theirs)}
    known = L._Forms()
    for _ in range(400):
        text = rng.choice([" ", "\n"]).join(rng.choice(words) for _ in range(9))
        other = "".join(swap.get(c, c) if rng.random() < 0.4 else c for c in unicodedata.normalize(rng.choice(["NFC", "NFD"]), text))
        other = "".join(c + ("‍" if rng.random() < 0.1 else "") for c in other).replace(" ", " " if rng.random() < 0.5 else " ")
        assert consistent_form(other, known) == consistent_form(text, known) == consistent_form(text)
        assert form(form(text)) == form(text)


def test_pairs(spark):
    rows = [(1, "peace", 0), (2, "реасе", 0), (3, "peace", 0), (4, "war", 0), (5, None, 0), (6, "", 0), (7, "peacе", 0), (8, "war", 0), (9, "​", 0), (10, "⁠", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form int")
    want = [(1, 2), (1, 7), (2, 3), (2, 7), (3, 7), (9, 10)]
    assert sorted(tuple(r) for r in same_looking_pairs(digests(docs)).collect()) == want
    assert sorted(tuple(r) for r in same_looking_pairs(digests(docs.union(docs))).collect()) == want
    assert same_looking_pairs(digests(docs.limit(0))).count() == 0
    classes = sorted(tuple(r) for r in look_classes(digests(docs)).collect())
    assert classes == [(1, 1, 4, 3), (2, 1, 4, 3), (3, 1, 4, 3), (4, 4, 2, 1), (7, 1, 4, 3), (8, 4, 2, 1), (9, 9, 2, 2), (10, 9, 2, 2)]
    assert look_classes(digests(docs.limit(0))).count() == 0
    got = {r["doc_id"]: r for r in forms(docs).collect()}
    assert got[2]["form"] == "peace" and got[2]["changed"] and not got[1]["changed"] and got[5]["form"] is None and got[6]["form"] == ""


def test_whole_table_against_forms(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").where("text <> ''").collect()
    by = {}
    for i, t in docs:
        by.setdefault(form(t), []).append((i, t))
    want = {(min(i, j), max(i, j)) for g in by.values() for i, t in g for j, u in g if t != u}
    assert {tuple(r) for r in p9_found(spark, data).collect()} == want
