"""Line dedup, mixing, quality rules and licence scan: defined cases and SQL on small tables."""

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from peakloom.llm import license_scan, license_texts, line_dedup, mixing, native_sql, quality_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PROSE = "The cat sat on a mat and it was warm there. Then a dog came in, and they ran off. "


def docs(spark, rows):
    """(doc_id, text, source) as documents."""
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def oracle(spark, df, sql, **tables):
    c = duckdb.connect()
    c.register("documents", df.toPandas())
    return [tuple(r) for r in c.sql(sql).fetchall()], [x[0] for x in c.description] if c.description else []


def clash(df, *names):
    """``df`` with columns named like results and inner columns."""
    return df.withColumns({n: F.lit("x") for n in names})


# --- line dedup -----------------------------------------------------------------------------

BOILER = "Subscribe to our newsletter"


def spread(n, extra=()):
    own = "\n".join(f"own line {{}} number {k} with some words" for k in range(4))
    return [(i, f"{BOILER}\n{own.format(*[i] * 4)}", f"s{i % 12}") for i in range(n)] + list(extra)


def test_boilerplate_goes_and_content_stays(spark):
    rows = spread(24, [(90, None, "s1"), (91, "", "s1"), (92, "only mine\n\n  " + BOILER + "  \nmore of mine, and more, and still more of it", None), (93, BOILER, "s3"), (94, f"{BOILER}\n own", "s3"), (3, spread(4)[3][1], "s3"), (None, f"{BOILER}\nno id", "s4")])
    got = line_dedup.clean_lines(clash(docs(spark, rows), "line", "pos", "extra")).orderBy("doc_id").collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and BOILER not in by[0].text and by[0].n_removed == 1 and by[0].n_lines == 5
    assert by[90].text is None and by[90].n_lines == 0 and by[91].text == "" and by[None].text == "no id"
    assert by[92].text == "only mine\n\nmore of mine, and more, and still more of it"
    assert by[93].text == "" and by[93].n_boilerplate == by[93].n_removed == 1 and by[94].text == " own"
    assert [r.text for r in got if r.doc_id == 3] == [by[3].text] * 2 and by[0].extra == "x"
    left = {r.doc_id: r for r in line_dedup.clean_lines(docs(spark, rows), max_share=0.5).collect()}
    assert left[93].text == BOILER and left[94].text == f"{BOILER}\n own" and left[93].n_removed == 0 and left[93].n_boilerplate == 1 and BOILER not in left[0].text


def test_names_of_results_may_clash(spark, tmp_path):
    df = clash(docs(spark, spread(24)), "N_Lines", "n_lines_", "n_removed", "copy", "Shuffle_Key")
    line_dedup.clean_lines(df).write.parquet(str(tmp_path / "lines"))
    got = spark.read.parquet(str(tmp_path / "lines"))
    assert got.columns == [*DOC_COLUMNS, "N_Lines__", "n_lines_", "n_removed_", "copy", "Shuffle_Key", "n_lines", "n_boilerplate", "n_removed"]
    assert got.first()["N_Lines__"] == got.first()["n_removed_"] == "x" and got.first()["n_removed"] == 1
    assert line_dedup.clean_lines(df, report=False).columns == df.columns
    mixing.mix(df).write.parquet(str(tmp_path / "mix"))
    got = spark.read.parquet(str(tmp_path / "mix"))
    assert got.columns == [*DOC_COLUMNS, "N_Lines", "n_lines_", "n_removed", "copy_", "Shuffle_Key_", "copy", "shuffle_key"]
    assert got.first()["copy_"] == "x" and mixing.mix(df, report=False).columns == df.columns


def test_lines_on_few_sites_stay_however_often(spark):
    rows = [(i, f"common\nown {i} and words of it", f"s{i % 9}") for i in range(200)]
    assert line_dedup.boilerplate(line_dedup.keyed_lines(docs(spark, rows))).count() == 0
    rows = [(i, f"common\nown {i} and words of it", f"s{i % 10}") for i in range(200)]
    assert line_dedup.boilerplate(line_dedup.keyed_lines(docs(spark, rows))).count() == 1


def test_near_lines_are_counted_exactly(spark):
    rows = [(i * 1000 + s, f"line {i}\nfiller of document {i} {s} which is long enough", f"site{s}") for i, n in enumerate((38, 39, 40, 41, 44)) for s in range(n)]
    assert line_dedup.boilerplate(line_dedup.keyed_lines(docs(spark, rows)), min_sites=40, lg_k=4).count() == 3


def test_pipeline_cleans_all_but_copies(spark):
    mostly = f"{BOILER}\nshort own"
    rows = spread(24, [(90, mostly, "s1"), (91, f"{BOILER}\ncopied", "s1"), (92, f"{BOILER}\ncopied", "s2"), (93, None, None), (94, BOILER, "s3")])
    by = {r.doc_id: r for r in corpus_pipeline.line_stage(spark, docs(spark, rows), "").collect()}
    assert len(by) == len(rows) and by[90].text == "short own" and by[90].n_chars == 9 and by[94].text == "" and by[93].text is None
    assert by[91].text == by[92].text == f"{BOILER}\ncopied" and BOILER not in by[0].text


def test_line_dedup_of_nothing(spark):
    assert line_dedup.clean_lines(docs(spark, [])).count() == 0


# --- mixing ---------------------------------------------------------------------------------


def test_counts_invert_the_distribution(spark):
    rate, n = 1.7, 4000
    us = [(i + 0.5) / n for i in range(n)]
    got = spark.createDataFrame([(u,) for u in us], "u double").select(mixing.poisson_count(F.lit(rate), F.col("u"))).collect()
    for (k,), u in zip(got, us, strict=True):
        cdf = lambda m: sum(math.exp(-rate) * rate**j / math.factorial(j) for j in range(m + 1))
        assert cdf(k) >= u and (k == 0 or cdf(k - 1) < u)
    assert spark.range(1).select(mixing.poisson_count(F.lit(0.0), F.lit(0.9)), mixing.poisson_count(F.lit(900.0), F.lit(0.5))).first()[:] == (0, 900)


def test_shares_follow_weights(spark):
    rows = [(i, "x" * 50, "big" if i % 3 else "small") for i in range(3000)]
    got = mixing.mix(docs(spark, rows), {"big": 0.25, "small": 0.75, "absent": 3.0}).groupBy("source").count().collect()
    counts = {r.source: r["count"] for r in got}
    total = sum(counts.values())
    assert counts["small"] / total == pytest.approx(0.75, abs=0.02)


def test_mixing_cases(spark):
    rows = [(None, "a", None), (1, None, "s"), (2, "", "s"), (2, "", "s"), (3, "long " * 500, "t")]
    df = clash(docs(spark, rows), "__k", "rate", "size")
    got = mixing.mix(df, epochs=40.0)
    assert got.columns == [*df.columns, "copy", "shuffle_key"]
    counts = {(r.doc_id, r.source): r["count"] for r in got.groupBy("doc_id", "source").count().collect()}
    assert set(counts) == {(None, None), (1, "s"), (2, "s"), (3, "t")} and counts[2, "s"] % 2 == 0
    assert sorted(map(str, mixing.mix(df, epochs=40.0).collect())) == sorted(map(str, got.collect()))
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.mix(df, {"nobody": 1.0}).count() == 0


def test_mixing_sql(spark):
    df = docs(spark, [(i, "w" * (i % 40), f"s{i % 7}") for i in range(400)])
    want, _ = oracle(spark, df, f"SELECT doc_id, copy, shuffle_key FROM ({native_sql.mixing_sql()})")
    assert sorted(want) == sorted(tuple(r) for r in mixing.mix(df).select("doc_id", "copy", "shuffle_key").collect())


# --- quality rules --------------------------------------------------------------------------


def brute_features(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    inside = {i + k for i, g in enumerate(windows) if windows.count(g) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


TEXTS = [None, "", " \t\n", "one", "a b", "a b c a b c", "x x x x", "é è ü | <b> & 100%", "l\nl\n\nl \nm", PROSE * 3, "# $ % " * 30, "a b c d a b c e f g a b"]


def test_features_against_brute_force(spark):
    df = docs(spark, [(i, t, "s") for i, t in enumerate(TEXTS)])
    got = quality_rules.features(clash(df, "n_words", "words")).select("doc_id", *[f"__q.{n}" for n in quality_rules.FEATURES[:5]]).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == [brute_features(t) for t in TEXTS]


def corpus():
    good = [(i, " ".join(f"word{i}x{k} of some kind." if k % 5 == 0 else f"word{i}y{k}" for k in range(120)), "s") for i in range(300)]
    marks = [(1000 + i, " ".join(f"w{i}z{k}%%%" for k in range(120)), "s") for i in range(30)]
    shout = [(2000 + i, " ".join(f"W{i}Z{k}Q!!".upper() for k in range(120)), "s") for i in range(30)]
    same = [(3000 + i, f"Again{i} " * 100, "s") for i in range(10)]
    return good, marks, shout, same


def test_model_finds_the_bad_kinds(spark):
    good, marks, shout, same = corpus()
    df = docs(spark, [*good, *marks, *shout, *same, (4000, None, "s"), (4001, "short text", "s"), good[0]])
    got = {r.doc_id: r for r in quality_rules.judge(clash(df, "kept", "posterior")).collect()}
    assert all(got[i].kept for i, _, _ in good) and not any(got[i].kept for i, _, _ in [*marks, *shout, *same])
    assert all(got[i].base_failed for i in (3000, 4000, 4001))
    kept = quality_rules.keep_good(clash(df, "kept", "posterior"))
    assert kept.count() == len(good) + 1 and kept.columns == [*df.columns, "kept", "posterior"]


def test_quality_of_nothing(spark):
    assert quality_rules.judge(docs(spark, [])).count() == 0
    assert quality_rules.keep_good(docs(spark, [])).count() == 0


def test_quality_sql(spark):
    good, marks, shout, same = corpus()
    df = docs(spark, [*good[:60], *marks, *shout, *same, *[(9000 + i, t, "s") for i, t in enumerate(TEXTS)]])
    want, _ = oracle(spark, df, native_sql.quality_sql())
    got = quality_rules.judge(df).select("doc_id", *quality_rules.FEATURES[:5], "base_failed", "kept").collect()
    assert sorted(want) == sorted(map(tuple, got))


# --- licence scan ---------------------------------------------------------------------------


def test_whole_texts_and_notices(spark):
    mit = license_texts.LICENSES[0][1]
    british = mit.replace("sublicense", "sub-licence").replace("License", "Licence")
    rows = [
        (1, f"Copyright (c) 2020 Somebody\n\n{british.upper()}\nAll rights reserved.", "s"),
        (2, "Some text.\nReleased under the MIT licence!\nMore.\n  released UNDER the mit license\nLicensed under CC BY-NC 4.0.", "s"),
        (3, "nothing here", "s"), (4, None, "s"), (5, "", "s"), (6, "Copyright 2001 me", "s"), (7, "...!?", "s"),
        (2, "Some text.\nReleased under the MIT licence!\nMore.\n  released UNDER the mit license\nLicensed under CC BY-NC 4.0.", "s"),
        (8, "SPDX-License-Identifier: Apache-2.0", "s"), (9, "long " * 40_000 + "\nReleased under the MIT License.", "s"), (None, "Released under the MIT License.", "s"),
    ]
    got = license_scan.scan(clash(docs(spark, rows), "license_id", "digest", "h")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: tuple(r)[1:] for r in got}
    assert by[1] == ("MIT", "", 0) and by[2] == (None, "CC-BY-NC-4.0,MIT", 3) and by[8] == ("Apache-2.0", "Apache-2.0", 1)
    assert all(by[i] == (None, "", 0) for i in (3, 4, 5, 6, 7)) and by[9] == (None, "MIT", 1) and by[None] == ("MIT", "MIT", 1)
    assert license_scan.scan(docs(spark, [])).count() == 0
    want, _ = oracle(spark, docs(spark, [r for r in rows if r[0] not in (None, 2)]), native_sql.license_sql())
    assert sorted(want) == sorted((k, *v) for k, v in by.items() if k not in (None, 2))


def test_every_known_text_finds_itself(spark):
    rows = [(i, t, "s") for i, (_, t) in enumerate(license_texts.LICENSES)]
    got = {r.doc_id: r.license_id for r in license_scan.scan(docs(spark, rows)).collect()}
    assert [got[i] for i in range(len(rows))] == [k for k, _ in license_texts.LICENSES]


def test_licences_of_a_folder(spark, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("Own Licence\n\nDo as you like, with this text kept.\nCopyright 1999 somebody\n")
    (tmp_path / "Other-2.0.txt").write_text("Do not do as you like.\n" * 3)
    known = license_scan.read_texts(spark, str(tmp_path))
    assert [k for k, _ in known] == ["Other-2.0", "Own-1.0"]
    rows = [(1, "OWN LICENSE -- do as you like; with this text kept", "s"), (2, "Do not do as you like." * 3, "s"), (3, None, "s"), (4, "do as you like", "s"), (1, "x", "s")]
    got = license_scan.whole_texts(clash(docs(spark, rows), "license_id", "digest"), known)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, "Own-1.0"), (2, "Other-2.0"), (3, None), (4, None), (1, None)]))
    assert license_scan.whole_texts(docs(spark, []), known).count() == 0
    if Path("/usr/share/common-licenses").is_dir():
        own = license_scan.read_texts(spark, "/usr/share/common-licenses")
        got = {r.doc_id: r.license_id for r in license_scan.whole_texts(docs(spark, [(i, t.upper(), "s") for i, (_, t) in enumerate(own)]), own).collect()}
        texts = [t for _, t in own]
        assert all(got[i] == min(k for k, u in own if u == texts[i]) for i in got)


@pytest.mark.skipif(not Path("/usr/share/common-licenses/GPL-3").is_file(), reason="no texts of long licences here")
def test_long_licences_are_known_by_their_digests(spark):
    names = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    texts = [Path("/usr/share/common-licenses", k).read_text() for k in names]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(100 + i, "Copyright 2020 Somebody\n\n" + t.upper().replace(",", " ;"), "s") for i, t in enumerate(texts)] + [(200, texts[0][:-400], "s")]
    df = docs(spark, rows)
    got = {r.doc_id: r.license_id for r in license_scan.scan(df).collect()}
    assert got == {i: k for i, k in enumerate(names.values())} | {100 + i: k for i, k in enumerate(names.values())} | {200: None}
    want, _ = oracle(spark, df, f"SELECT doc_id, license_id FROM ({native_sql.license_sql()})")
    assert dict(want) == got


def test_line_dedup_sql(spark):
    df = docs(spark, spread(24, [(90, None, "s1"), (91, "", "s1"), (93, BOILER, "s3")]))
    want, _ = oracle(spark, df, f"SELECT doc_id, text, n_lines, n_boilerplate, n_removed FROM ({native_sql.line_dedup_sql()})")
    got = line_dedup.clean_lines(df).select("doc_id", "text", "n_lines", "n_boilerplate", "n_removed").collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
