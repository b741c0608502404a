"""Archives, nearest neighbours, the registered queries and the pipeline."""

import gzip
import hashlib
import math
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import same  # noqa: E402

import corpus_pipeline  # noqa: E402
from candlewick.llm import neighbours, oracles, queries, warc  # noqa: E402
from candlewick.llm.common import new_path  # noqa: E402
from candlewick.llm.components import components  # noqa: E402

PAGES = [(1, "u", "x" * 5_000_000), (2, None, "x" * 5_000_000), (3, "a b\r\nc", None), (4, "q", ""), (None, "z", "y" * 2000), (5, "z", "y" * 2000), (5, "z", "y" * 2000), (6, "s", "é" * 600), (7, "s", "é" * 600), (8, "t", "short"), (9, "t", "short"), (10, "w", "WARC/1.1\r\n\r\n" * 200)]


@pytest.mark.parametrize("block", [1, 16 << 20])
def test_archives(spark, monkeypatch, block):
    monkeypatch.setattr(warc, "BLOCK", block)
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS n", "3 AS refers_to")
    path = new_path(spark, "warc")
    blocks = warc.write_archives(df, path, chunk_bytes=100_000)
    rows = warc.read_archives(blocks, chunk_bytes=70_000).collect()
    whole = defaultdict(list)
    for r in rows:
        whole[(r.page_id, r.record_type, r.refers_to)].append(r)
    last = [r for r in rows if r.last]
    assert len(last) == len(PAGES)
    for r in last:
        html = next(h for p, _, h in PAGES if p == r.page_id) or ""
        assert r.payload_bytes == len(html.encode()) and r.digest_so_far == hashlib.sha1(html.encode()).hexdigest()
        larger = [p for p, _, h in PAGES if p is not None and h == html and r.page_id is not None and p > r.page_id]
        assert (r.record_type, r.refers_to) == (("revisit", max(larger)) if larger and len(html.encode()) >= 1000 else ("response", None))
    big = sorted(whole[(2, "response", None)], key=lambda r: r.chunk_no)
    assert b"".join(r.data for r in big).decode() == "x" * 5_000_000 and max(len(r.data) for r in big) <= 70_000
    seen = hashlib.sha1()
    for r in big:
        seen.update(r.data)
        assert r.digest_so_far == seen.hexdigest()
    text = b"".join(gzip.open(f).read() for f in Path(path.removeprefix("file://")).glob("*.warc.gz"))
    assert text.count(b"WARC-Type: revisit") == 2 and text.count(b"WARC-Record-ID") == len(PAGES)
    assert warc.read_archives(warc.write_archives(df.limit(0), new_path(spark, "warc"))).count() == 0


def brute_neighbours(rows, k=20):
    out = {}
    for q, v in rows:
        if q % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)
            out[q] = [(i, -x) for x, i in s[:k]]
    return out


def vectors(n, d, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    x = centres[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, d))
    x[: n // 3] = x[0]  # one vector that many rows share
    return [(i, [float(v) for v in np.float32(row)]) for i, row in enumerate(x)]


def test_every_vector_length_is_searched(spark, monkeypatch):
    """Any limit on rows is scaled down to two here: no length may depend on one."""
    from pyspark.sql import functions as F

    for cls in {neighbours.DataFrame, type(spark.range(1))}:
        monkeypatch.setattr(cls, "limit", lambda self, n, limit=cls.limit: limit(self, min(n, 2)))
    monkeypatch.setattr(neighbours, "WIDTHS", 2, raising=False)
    df = spark.createDataFrame([(10 * w + i, [float(i + 1)] * w) for w in range(1, 4) for i in range(3)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in neighbours.search(df, F.col("vec_id") % 10 == 0).collect()}
    assert got == {(10 * w, 10 * w + i) for w in range(1, 4) for i in (1, 2)}


def test_neighbours(spark):
    rows = vectors(1500, 16)
    odd = [(5001, None), (5002, [0.0] * 16), (5003, [float("nan")] + [1.0] * 15), (5004, [float("inf")] + [1.0] * 15), (5005, [None] + [1.0] * 15), (None, [1.0] * 16), rows[20], rows[40]]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "1 AS cell", "2 AS key", "3 AS v")
    from pyspark.sql import functions as F

    got = defaultdict(list)
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, neighbours.Index(cell=64)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = brute_neighbours(rows)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values())) and all(len(got[q]) == 20 for q in want)
    vec = dict(rows)
    for q in want:
        assert all(math.isclose(s, sum(a * b for a, b in zip(vec[q], vec[i])), rel_tol=1e-12) for i, s in got[q])
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))
    assert got[20] == want[20]  # ties go to the smaller ids


def test_few_candidates(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in neighbours.search(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1)]
    assert neighbours.search(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_chi_square():
    assert math.isclose(neighbours.chi_square(neighbours.quantile(0.9, 8), 8), 0.9, rel_tol=1e-9)
    assert math.isclose(neighbours.quantile(0.95, 8), 15.507, rel_tol=1e-3)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 51)}, 95: 90, 100: 90, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_same_rows_as_sql(spark, sf, duck, name):
    same(queries.QUERIES[name](spark, sf), duck, oracles.ORACLES[name])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_queries_cover_their_tables(spark, sf, name):
    got = queries.QUERIES[name](spark, sf)
    if name.startswith("op7"):
        assert got.select("query_id").distinct().count() == spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 20 = 0").count()
    elif name.startswith("op1_"):
        assert got.count() == spark.read.parquet(f"{sf}/pages.parquet").count()
    elif not name.startswith("op9"):
        assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_pipeline(spark, sf):
    """Each stage on all that the one before kept, against its brute-force version."""
    from test_text_operators import brute_components, brute_dropped, brute_fingerprint, brute_mix, words_of

    from candlewick.llm import quality
    from candlewick.llm.common import written

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_deduplication", "near_duplicates", "source_mixing", "sentencepiece"]
    rows = {r.doc_id: r for r in docs.collect()}
    one, _ = written(stages["quality_rules"](spark, docs, sf), "t")
    base = {d for d, r in rows.items() if (c := quality.counts(r.text)) and not (c[0] < 10 or 100 * c[4] > 20 * c[0])}
    kept = {r.doc_id for r in one.collect()}
    assert one.columns == columns and kept <= base and len(kept) >= 0.9 * len(base)
    two, _ = written(stages["line_deduplication"](spark, one, sf), "t")
    gone = brute_dropped([(d, rows[d].text) for d in kept])
    texts = {r.doc_id: r.text for r in two.collect()}
    assert two.columns == columns and texts == {d: "\n".join(x for k, x in enumerate(rows[d].text.split("\n")) if k not in gone[d]) for d in kept}
    three, _ = written(stages["near_duplicates"](spark, two, sf), "t")
    ids = sorted(texts)
    left = {r.doc_id for r in three.collect()}
    assert three.columns == columns and left == set(brute_components(ids, [brute_fingerprint(texts[d]) for d in ids]))
    four, _ = written(stages["source_mixing"](spark, three, sf), "t")
    leaves = [(d, {1: "books", 2: "forum"}.get(int(rows[d].source[3:]) % 3, "web"), rows[d].lang, rows[d].source, len(words_of(texts[d]))) for d in left]
    mixed = {r.doc_id for r in four.collect()}
    assert four.columns == columns and mixed == {d for _, d in brute_mix(leaves, corpus_pipeline.MIX)}
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    for r in stages["sentencepiece"](spark, four, sf).collect():
        ids_ = sp.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids_) and r.ids_md5 == hashlib.md5(",".join(map(str, ids_)).encode()).hexdigest() and r.decoded_md5 == hashlib.md5(texts[r.doc_id].encode()).hexdigest()
    assert corpus_pipeline.run(spark, sf).count() == len(mixed)
