"""The registered queries against their SQL, and the pipeline stage by stage against brute force."""

import collections
import re
import zlib

import duckdb
import numpy as np
import pytest
from test_llm_operators import base_counts, links, order

import corpus_pipeline
from placeloom.llm import mixing, queries
from placeloom.llm.common import staged

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, duck, name):
    df, relation = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(relation.columns) == columns
    assert sorted(tuple(map(repr, (r[c] for c in columns))) for r in df.collect()) == sorted(tuple(map(repr, r)) for r in relation.select(*map(duckdb.ColumnExpression, columns)).fetchall())


def test_pipeline(spark, duck):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    after, tables = [], docs
    for _, stage in corpus_pipeline.STAGES:
        tables = staged(stage(spark, tables, SF), "snappy")
        after.append(tables)
    columns = docs.columns
    assert [t.columns for t in after[:-1]] == [columns] * 4
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    # 200 documents hold too few labels to certify any cutoff.
    good = [(i, t) for i, t in rows if (c := base_counts(t))[0] >= 50 and 100 * c[4] <= 50 * c[0]]
    assert ids(after[0]) == sorted(i for i, _ in good)
    judged = links(good)
    one = sorted(i for i, c, _ in judged if i == c)
    assert ids(after[1]) == one
    words = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    split = lambda t: words.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [split(t) for (t,) in duck.sql("select text from benchmark").fetchall()]
    windows = {tuple(w[j : j + 10]) for w in items for j in range(max(1, len(w) - 9)) if w}
    text = dict(rows)
    clean = [i for i in one if not any(tuple(w[j : j + n]) in windows for w in [split(text[i])] for n in {len(x) for x in windows} for j in range(len(w) - n + 1))]
    assert ids(after[2]) == clean == ids(after[3])
    placed = {r.doc_id: r.position for r in mixing.mix_sources(after[2], queries.TARGETS, 64, "doc_id").collect()}
    tokenizer = Tokenizer.from_file(queries.vocabulary_path())
    at, want = 0, []
    for i in sorted(clean, key=placed.get):
        got = [*tokenizer.encode(text[i], add_special_tokens=False).ids, 1]
        want.append((i, at, len(got), zlib.crc32(np.array(got, "<u4").tobytes())))
        at += len(got)
    assert sorted(map(tuple, after[4].collect())) == sorted(want)


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 100


def test_html_query_takes_the_article(spark):
    rows = {r.page_id: r for r in queries.op6_html_extraction(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        article = re.search("<article>(.*)</article>", p.html, re.S)[1]
        blocks = [" ".join(re.sub("<[^>]*>", " ", b).replace("&amp;", "&").split()) for b in re.split("</?(?:p|h1)>", article)]
        assert rows[p.page_id].text == "\n".join(b for b in blocks if b) and rows[p.page_id].n_chars == len(rows[p.page_id].text)


def test_mixing_query_interleaves(spark):
    got = queries.op5_mix_sources(spark, SF).collect()
    assert sorted(r.position for r in got) == list(range(len(got)))
    assert collections.Counter(r.doc_id for r in got).most_common(1)[0][1] == 1 and order(None) < 0


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls everywhere, repeated rows, extra columns; and no rows at all."""
    good = " ".join(f"word{i} is here," for i in range(40))
    rows = [(1, good, "en", "a", 5, 0), (1, good, "en", "a", 5, 0), (2, good + " more", None, None, None, 1), (None, " ".join(f"other{i} thing" for i in range(60)), "en", "a", 1, 2), (4, None, "en", None, None, 3), (5, "", None, "b", 0, 4)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row long"
    for name, these in (("some", rows), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(these, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (2, None, 0)] if these else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, None), (2, "")] if these else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert sorted(r.doc_id or -1 for r in got) == ([-1, 1] if these else [])
