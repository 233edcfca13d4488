"""Word BPE, spelling variants and filter audit: against the tokenizer, plain loops and SQL on small tables."""

import collections
import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from peakloom.llm import filter_audit, native_sql, queries, spelling, word_bpe

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


# --- word BPE -------------------------------------------------------------------------------

LIBRARY = Tokenizer.from_file(word_bpe.vocabulary())
HARD = [
    None, "", " \n\t", "Hello <|endoftext|>World's café ÀΣΣ  x y 12ab <|startoftext|>!", "<|endoftext|><|<|startoftext|>|>", "a\x1cb\x85c d　e \x00\x01 f",
    "école ẍ́ ẛ̣ ̈a", "İSTANBUL ΟΔΟΣ. ﬁ Å K Ω", "日本語 한국어 각 ३४५ ½²", "don't we'll I'M they'Re 'S '' ''s", "👍🏽👨‍👩‍👧 😀abc", "ab" * 5000, "x" * 70, "y" * 64, "z" * 65, "=" * 300,
]


def by_library(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def by_codec(texts):
    c = word_bpe.codec(word_bpe.vocabulary())
    ids = c.encode(pa.array(texts, pa.string()))
    return [(np.frombuffer(i, "<u4").tolist(), t) for i, t in zip(ids.to_pylist(), c.decode(ids).to_pylist(), strict=True)]


def test_ids_and_texts_are_the_tokenizers():
    rng = random.Random(4)
    letters = "abcdefgh ABC'srevl.,!?#é́ßΣσ \t\n0123你好<|> "
    texts = HARD + ["".join(rng.choices(letters, k=rng.randint(1, 80))) for _ in range(800)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 0x2FF), rng.randint(0x300, 0x1FFF), rng.randint(0x2000, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(50)) for _ in range(100)]
    assert by_codec(texts) == [by_library(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_any_text(texts):
    assert by_codec(texts) == [by_library(t) for t in texts]


def scanned(symbols, ranks):
    """The leftmost pair of lowest rank, again and again."""
    symbols = list(symbols)
    while found := min(((ranks[p][0], i) for i, p in enumerate(itertools.pairwise(symbols)) if p in ranks), default=None):
        i = found[1]
        symbols[i : i + 2] = [ranks[symbols[i], symbols[i + 1]][1]]
    return symbols


def test_both_trees_merge_leftmost_lowest(monkeypatch):
    monkeypatch.setattr(word_bpe, "CELLS", 64)  # several blocks a class
    rng, ranks, new = random.Random(9), {}, 10
    while len(ranks) < 200:
        pair = (rng.randrange(new), rng.randrange(new))
        if pair not in ranks:
            ranks[pair] = (len(ranks), new)
            new += 1
    words = [[rng.randrange(12) for _ in range(rng.randint(1, 64))] for _ in range(400)] + [[3] * n for n in range(1, 65)]
    want = [scanned(w, ranks) for w in words]
    assert [word_bpe.merged(w, ranks) for w in words] == want
    ends = np.cumsum([len(w) for w in words])
    out = word_bpe.merged_together(np.concatenate(words).astype(np.int64), ends, word_bpe.Pairs(ranks))
    assert [[s for s in x.tolist() if s >= 0] for x in np.split(out, ends[:-1])] == want
    long = [rng.randrange(12) for _ in range(2000)]
    monkeypatch.setattr(word_bpe, "LONG_WORD", 1000)
    assert word_bpe.merged(long, ranks) == scanned(long, ranks)


def test_op11_query(spark, tmp_path):
    rows = [(i, t, "s") for i, t in enumerate(HARD)] + [(1, HARD[3], "s"), (None, HARD[4], None)]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.op11_word_bpe(spark, str(tmp_path)).collect()), key=str)
    want = [(i, by_library(t)) for i, t, _ in rows]
    assert got == sorted(((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for i, (x, d) in want), key=str)


def test_columns_of_encode_and_decode(spark):
    df = docs(spark, [(1, "one two", "s")]).withColumn("IDS", F.lit(5)).withColumn("decoded", F.lit("x"))
    out = word_bpe.decode(word_bpe.encode(df))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "IDS_", "decoded_", "ids", "decoded"]
    row = out.first()
    assert row.decoded == "one</w> two</w>" and row.IDS_ == 5 and row.decoded_ == "x" and row.text == "one two"
    assert word_bpe.encode(df.limit(0)).count() == 0 and word_bpe.decode(spark.createDataFrame([(None,)], "ids binary")).first().decoded == ""
    with pytest.raises(Exception, match="not in the vocabulary"):
        word_bpe.decode(spark.createDataFrame([((60000).to_bytes(4, "little"),)], "ids binary")).collect()


# --- spelling variants ----------------------------------------------------------------------


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelled(rows):
    counts = collections.Counter()
    for i, text, _ in rows:
        run = ""
        for c in (text or "") + " ":
            if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if "A" <= c <= "Z" else c
                continue
            if run:
                h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
                counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
            run = ""
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    forms, out = {}, []
    for w in n:
        around = [v for v in n if near(w, v)]
        best = min(around, key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best and n[best] >= 5 * n[w] else None
        out.append([w, forms[w], None, n[w], len(around), n[best] if forms[w] else None])
    for row in out:
        row[2] = row[0]
        while forms[row[2]]:
            row[2] = forms[row[2]]
    return sorted(map(tuple, out))


def misspelled(seed):
    """Words with their near words, in chains of growing counts, with letters that repeat, accents and ties."""
    rng, rows = random.Random(seed), []
    stems = ["banana", "bananna", "mississippi", "écolex", "éccole", "straße", "aaaaaa", "aaaaaaa", "aaaaab", "abaaaa", "hello×you", "ÉCOLES", "Écoles"]
    for k in range(8):
        stems.append("".join(rng.choices("abé", k=7)))
    for stem in stems:
        count = rng.choice([5, 25, 130])
        rows += [(len(rows) + i, f"{stem}, {stem.upper() if stem.isascii() else stem}! {stem}", "s") for i in range(count // 3 + 1)]
        for _ in range(4):
            i = rng.randrange(len(stem))
            other = rng.choice([stem[:i] + rng.choice("abé") + stem[i + 1 :], stem[:i] + stem[i + 1 :], stem[:i] + rng.choice("abé") + stem[i:]])
            rows += [(len(rows) + j, f"{other} short {other}", "s") for j in range(rng.choice([1, 3, 4, 15]))]
    return rows + [(None, "banana Bananaa", None), (7, None, "s"), (8, "", "s"), (8, "", "s")]


@pytest.mark.parametrize("seed", [1, 2])
def test_spelling_against_plain_loops(spark, seed):
    rows = misspelled(seed)
    df = docs(spark, rows)
    got = sorted(map(tuple, spelling.variants(df.withColumn("word", F.lit(1)).withColumn("n", F.lit(2))).collect()))
    want = spelled(rows)
    assert got == want and any(r[1] for r in want) and any(r[4] > 1 for r in want)
    c = duckdb.connect()
    c.register("documents", df.toPandas().astype({"doc_id": "Int64"}))
    assert sorted(c.sql(native_sql.spelling_sql()).fetchall(), key=lambda r: r[0]) == want


def test_chain_of_roots_and_empty_table(spark):
    counts = {"abcdef" + "x" * k: 5 * 5**k for k in range(6)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: r for r in spelling.with_roots(spelling.near_forms(words)).collect()}
    top = max(counts, key=counts.get)
    assert all(r.root == top for r in got.values()) and got[top].form is None and got["abcdef"].form == "abcdefx" and got["abcdefx"].n_near == 2
    assert spelling.variants(docs(spark, [])).count() == 0


# --- filter audit ---------------------------------------------------------------------------


def audited(rows, labels):
    """Each order applied to each part, document by document."""
    table, out = [], {}
    for i, text, source in rows:
        text = text or ""
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        copy = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": any(c in "#$%&*|" for c in text), "E": copy}
        table.append((source or "", fails, any(k == i and q == 1 for k, q, _ in labels if i is not None), any(k == i and t == 1 for k, _, t in labels if i is not None)))
    for part in {p for p, *_ in table}:
        own, shapley = [r[1:] for r in table if r[0] == part], collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if r[0][f]], [r for r in left if not r[0][f]]
                fails = [r for r in own if r[0][f]]
                shapley[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), len(fails) - len(gone), sum(sum(r[0].values()) == 1 for r in fails), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return sorted((*k, *v) for k, v in out.items())


def filtered(seed, n=60):
    rng, rows = random.Random(seed), [(90, None, None), (91, "", ""), (92, "x", None), (None, "x", None), (None, None, "a")]
    for i in range(n):
        words = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(rng.choice([10, 49, 50, 60]))]
        text = rng.choice([" ", "\n", " \x0b "]).join(words) + rng.choice(["", "", "#", "*"])
        rows.append((i, text.upper() if rng.random() < 0.2 else text, rng.choice(["a", "a", "b", None])))
    rows += [(i + 30, t, s) for i, t, s in rng.sample(rows[5:], 15)]  # copies, some of them below a repeated id
    rows += rows[5:7]
    return rows, [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 95, 2)] + [(4, 1, 1), (None, 1, 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_against_plain_loops(spark, seed):
    rows, labels = filtered(seed)
    df, known = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, filter_audit.audit(filter_audit.cells(filter_audit.failures(df.withColumn("mask", F.lit("x"))), known.withColumn("part", F.lit(0)))).collect()))
    want = audited(rows, labels)
    assert got == want
    c = duckdb.connect()
    c.register("documents", df.toPandas().astype({"doc_id": "Int64"}))
    c.register("labels", known.toPandas().astype({"doc_id": "Int64", "quality": "Int64"}))
    assert sorted(c.sql(native_sql.audit_sql()).fetchall()) == want


def test_walk_visits_all_orders_by_swaps():
    for n in range(1, 7):
        order, seen = list(range(n)), []
        for swap in [None, *filter_audit.transpositions(n)]:
            if swap is not None:
                order[swap], order[swap + 1] = order[swap + 1], order[swap]
            seen.append(tuple(order))
        assert sorted(seen) == sorted(itertools.permutations(range(n)))


def test_audit_of_empty_tables_and_many_parts(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "PARTS", 3)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.cells(filter_audit.failures(docs(spark, [])), none)).count() == 0
    rows = [(i, "x" if i % 2 else "#", f"s{i % 11}") for i in range(44)]
    got = sorted(map(tuple, filter_audit.audit(filter_audit.cells(filter_audit.failures(docs(spark, rows)), none)).collect()))
    assert got == audited(rows, [])
