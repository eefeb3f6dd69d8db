import hashlib
import re
from collections import Counter, defaultdict

import pytest
from oracle import rows_of, sql_rows

from inkgraph.llm import queries as Q
from inkgraph.llm import warc
from inkgraph.llm.mixing import mix_sources, targets

WORD = "[^\x20\x09-\x0d]+"


def test_warc_round_trip(spark):
    x = "x" * 100
    rows = [(1, None, None), (2, "u", ""), (3, "http://é/ \n", x), (4, "u", x), (5, "u", "a"), (6, "u", "a"), (None, "u", x), (7, "u", "\r\n\r\n" * 60), (4, "u", x), (8, "u", "é" * 50), (9, "u", "é" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "page_id AS digest", "1 AS kind")
    manifest = warc.write_archives(pages, warc.new_folder(spark), archive_bytes=600)
    got = warc.read_archives(manifest).collect()
    last = 1 << 70
    first = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100:
            first[b] = min(first.get(b, last), last if p is None else p)
    want = Counter()
    for p, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and (last if p is None else p) != first[b]
        want[(p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response"}[7] == "\r\n\r\n" * 60
    assert warc.read_archives(warc.write_archives(pages.limit(0), warc.new_folder(spark))).count() == 0
    assert manifest.count() > 1


def test_archive_format():
    records = [warc.record("response", f"k{i}", f"<p>{i} some text that repeats</p>".encode() * 20, {"A": str(i)}) for i in range(300)]
    data = warc.archive(records)
    assert list(warc.unpack(data)) == records and len(data) < sum(map(len, records)) / 3
    assert list(warc.unpack(warc.archive([b"x"]))) == [b"x"]
    assert warc.parse(records[3])[0]["A"] == "3"
    with pytest.raises(ValueError):
        list(warc.unpack(data[:-3]))


def test_targets(spark):
    sizes = spark.createDataFrame([("va", "a", 100), ("vb", "b", 100), ("vc", "c", 1000), ("n", None, 10), ("vz", "z", 0)], "skey string, source string, source_size long")
    got = {r.skey: r.target for r in targets(sizes).collect()}
    # weights: a 5, b 2, c 1, z 5, null 2; a, b and null are capped, the rest goes to c
    assert got == {"va": 200, "vb": 200, "n": 20, "vz": 0, "vc": pytest.approx(1.5 * 1210 - 420)}


def test_mix_by_hand(both):
    plan = mix_sources(both, block=16, shard_words=4000)
    rows = plan.taken().collect()
    assert len(rows) == both.count()
    by = defaultdict(lambda: [0, 0, 0])
    for r in rows:
        assert r.taken <= 2 * r.size
        s = by[r.source]
        s[0] += r.size
        s[1] += r.taken
        assert s[2] in (0, r.target)
        s[2] = r.target
        assert r.source_size >= r.size
    assert all(abs(t - g) <= 0.5 for _, t, g in by.values())
    assert sum(g for *_, g in by.values()) == pytest.approx(1.5 * sum(s for s, *_ in by.values()))
    words = defaultdict(list)
    for r in both.collect():
        words[(r.doc_id, r.source)].append(re.findall(WORD, r.text or ""))
    texts = plan.texts().collect()
    assert all(t.text.split(" ") == w[t.word_from : t.word_from + t.n] for t in texts for w in words[(t.doc_id, t.source)])
    assert sum(t.n for t in texts) == sum(r.taken for r in rows)
    slots = Counter()
    for t in texts:
        slots[(t.shard, t.slot)] += t.n
    assert max(slots.values()) == 16
    key = lambda rs: Counter((r.doc_id, r.source, r.size, r.taken) for r in rs)
    assert key(mix_sources(both.repartition(7), block=16, shard_words=4000).taken().collect()) == key(rows)
    assert mix_sources(both.limit(0)).taken().count() == 0


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert rows_of(Q.queries()[name](spark, sf)) == sql_rows(Q.oracle_sql()[name], sf)


def test_each_operator_has_its_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in Q.queries()) == list(range(1, 14))


def test_pipeline_equals_plain_stages(spark, tmp_path):
    import corpus_pipeline as C
    from test_models import shingles
    from test_near_dedup import brute

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(5000, "1 2 3", None, "src0", 5), (5001, None, None, "src0", 0), (5002, "½ ²", None, "src0", 3)], docs.schema)
    docs = docs.unionByName(extra)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = {r.doc_id: r.text for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    groups = defaultdict(list)
    for i, t in rows.items():
        groups[re.sub("[\x20\x09-\x0d]", "", t)].append(i)
    rows = {i: rows[i] for i in (min(g, key=lambda k: (-len(rows[k]), k)) for g in groups.values())}
    rows = {i: rows[i] for i, c in brute(rows).items() if i == c}
    items = [s for s in (shingles(r.text) for r in bench.collect()) if s]
    rows = {i: t for i, t in rows.items() if not any(5 * len(shingles(t) & s) >= 4 * len(s) for s in items)}
    out = C.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= set(rows)
    size = sum(len(re.findall(WORD, t)) for t in rows.values())
    assert sum(r.n for r in out) == pytest.approx(1.5 * size, abs=20)
    kept = docs
    for name, stage in C.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
    assert {r.doc_id for r in kept.collect()} == set(rows)


def test_permuted_is_a_bijection(spark):
    from pyspark.sql import functions as F

    from inkgraph.llm.mixing import permuted

    sizes = spark.createDataFrame([(n,) for n in (1, 2, 3, 7, 64, 1000, 4097)], "n long")
    rows = sizes.select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")).select("n", "i", permuted(F.col("i"), F.col("n"), [F.lit(5), F.col("n")]).alias("to")).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.n].append((r.i, r.to))
    assert all(sorted(t for _, t in x) == list(range(n)) for n, x in by.items())
    assert sum(i == t for i, t in by[4097]) < 20


def test_shards_draw_their_counts(spark):
    from inkgraph.llm.mixing import shard_counts

    slots = {"va": 6000, "vb": 3000, "vc": 999, "vd": 1}
    plan = spark.createDataFrame(list(slots.items()), "skey string, slots long")
    rows = shard_counts(plan, 10_000, 500, 3).collect()
    for k, n in slots.items():  # the ranges of a source are its slots, without gaps
        own = sorted((r["start"], r["count"]) for r in rows if r["skey"] == k)
        assert own[0][0] == 0 and sum(c for _, c in own) == n and all(a + c == b for (a, c), (b, _) in zip(own, own[1:], strict=False))
    drawn = [r["count"] for r in rows if r["skey"] == "va" and r["shard"] < 18]
    assert len(drawn) == 18 and all(230 < c < 370 for c in drawn) and len(set(drawn)) > 5  # 300, give or take 11
    settled = sum(r["count"] for r in rows if r["shard"] >= 20)
    assert settled < 400


def test_clashing_columns_change_nothing(spark, clashing):
    import corpus_pipeline as C

    from inkgraph.llm.decontaminate import contained_items, decontaminate
    from inkgraph.llm.langid import keep_identified, language_id
    from inkgraph.llm.near_dedup import near_groups

    plain = clashing.select("doc_id", "text", "lang", "source")
    bench = spark.createDataFrame([(1, "the cat sat on the mat"), (2, None)], "item_id long, text string")
    rows = lambda df: sorted(map(repr, df.collect()))
    for op in (language_id, near_groups, lambda d: contained_items(d, bench), lambda d: mix_sources(d).taken().drop("rid")):
        assert rows(op(clashing)) == rows(op(plain))
    for keep in (keep_identified, lambda d: decontaminate(d, bench), lambda d: C.drop_copies(spark, d, ""), lambda d: C.drop_near_copies(spark, d, "")):
        got = keep(clashing)
        assert got.columns == clashing.columns and rows(got.select(plain.columns)) == rows(keep(plain))


def test_pipeline_takes_empty_tables_nulls_and_clashing_columns(spark, clashing, docs, tmp_path):
    import corpus_pipeline as C

    def run(rows, bench, name):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        return C.run(spark, f"{tmp_path}/{name}")

    bench = spark.createDataFrame([(1, "the cat sat on the mat"), (2, None)], "item_id long, text string")
    columns = ["shard", "slot", "source", "doc_id", "word_from", "n", "text"]
    assert run(docs.limit(0), bench, "none").select(columns).count() == 0
    assert run(docs.selectExpr("doc_id", "CAST(NULL AS string) AS text", "CAST(NULL AS string) AS lang", "source"), bench, "nulls").count() == 0
    plain = clashing.select("doc_id", "text", "lang", "source")
    rows = lambda df: sorted(map(repr, df.select(columns).collect()))
    got = rows(run(clashing, bench, "clash"))
    assert got == rows(run(plain, bench, "plain")) and got
    assert rows(run(clashing, bench.limit(0), "free"))
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, clashing, f"{tmp_path}/plain").columns == clashing.columns
