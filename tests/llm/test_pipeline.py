import os
import random

import pytest

import corpus_pipeline as p

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in p.STAGES[:-1]:
        out = p.keep(stage(spark, docs, DATA), "test")
        assert out.columns == columns and 0 < out.count() <= n, name
        docs, n = out, out.count()
    mixed = p.STAGES[-1][1](spark, docs, DATA)
    kept = {r[0] for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in mixed.select("doc_id").collect()} <= kept


ROWS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_groups(rows):
    """Groups of row places that link at 0.8 over five-word shingles."""
    words = [(t or "").lower().split() for _, t, *_ in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    out = {}
    for k in range(len(rows)):
        out.setdefault(find(k), []).append(k)
    return list(out.values())


def test_near_duplicates_by_brute_force(spark):
    r = random.Random(2)
    rows = []
    for g in range(12):
        base = [f"g{g}x{k}" for k in range(60)]
        for k in range(6):
            w = base[:]
            for _ in range(r.randint(0, 3)):
                w[r.randrange(60)] = f"n{r.randrange(10**6)}"
            # ids are shared and missing
            rows.append((None if r.random() < 0.2 else r.randrange(30), " ".join(w), "en", f"s{k}", 1))
    rows += [rows[0], rows[0], rows[7], (5, None, None, None, None), (5, None, None, None, None), (None, "", "en", "s", 0), (6, "x " * 20_000, "en", "s", 2), (6, "y z", "en", "s", 2), (6, "y z", "en", "s", 2)]
    got = [tuple(x) for x in p.near_duplicates(spark, spark.createDataFrame(rows, ROWS).repartition(3), "").collect()]
    groups = brute_groups(rows)
    assert len(got) == len(groups)
    for g in groups:
        members = [rows[k] for k in g]
        ids = [m[0] for m in members if m[0] is not None]
        assert sum(got.count(m) > 0 for m in set(members)) == 1 or not (members[0][1] or "").split()
        assert any(m in got and (not ids or m[0] == min(ids)) for m in members)


def test_decontamination_goes_by_row(spark, tmp_path):
    item = " ".join(f"item{k}" for k in range(20))
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, f"some words {item} and more", "en", "s", 1), (1, "clean words", "en", "s", 1), (None, f"{item}!", None, None, None), (None, None, None, None, None), (4, "", "en", "s", 0), (5, "w " * 30_000 + item, "en", "s", 0), (1, "clean words", "en", "s", 1)]
    got = sorted((tuple(x) for x in p.decontamination(spark, spark.createDataFrame(rows, ROWS), str(tmp_path)).collect()), key=str)
    assert got == sorted((x for x in rows if "item3" not in (x[1] or "")), key=str)


def test_secret_scan_masks(spark):
    rows = [(1, "a token=abcdefgh b", "en", "s", 18), (None, None, None, None, 7), (1, "", "en", "s", 0), (2, "é " * 30_000 + "AKIA" + "A" * 16, "en", "s", 1)]
    got = {x.n_chars: x for x in p.secret_scan(spark, spark.createDataFrame(rows, ROWS), "").collect()}
    assert got[12].text == "a [secret] b" and got[7].text is None and got[0].text == "" and got[60_008].text == "é " * 30_000 + "[secret]"


def test_quality_needs_both_labels(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, "x", "en", "s", 1), (1, "y", None, None, None), (None, None, None, None, None), (2, "w " * 30_000, "en", "s", 1)]
    assert p.quality(spark, spark.createDataFrame(rows, ROWS), str(tmp_path)).count() == 4
    assert p.quality(spark, spark.createDataFrame([], ROWS), str(tmp_path)).count() == 0


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in p.STAGES:
        if os.path.isdir(DATA):
            assert stage(spark, docs, DATA).count() == 0, name
