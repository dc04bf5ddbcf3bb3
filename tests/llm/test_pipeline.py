"""The pipeline against a plain version, and SQL of the corpus queries against DuckDB."""

import glob
import os
import random
import re
from pathlib import Path

import duckdb
import pytest
import sentencepiece

import corpus_pipeline
from tests.llm.test_pairs import sets_of
from verbena.llm.queries import ORACLE_SQL, QUERIES, piece_model
from verbena.llm.secrets import scan

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
BAD = ["moronic", "scumbag", "idiotic"]


def write_tables(spark, folder):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    items = [(k, " ".join(word() for _ in range(14))) for k in range(5)]
    rows, labels = [], []
    for k in range(240):
        words = [word() for _ in range(r.randint(12, 60))]
        toxic = k % 6 == 0
        if toxic:
            words.insert(3, r.choice(BAD))
        text = " ".join(words)
        if k % 17 == 1:
            text += " " + r.choice(items)[1]
        if k % 13 == 2:
            text += ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'
        rows.append([k, text, "en", f"src{k % 3}", len(text)])
        labels.append((k, 1, int(toxic)))
    for k in range(30):  # copies and near copies
        text = rows[k * 5 + 1][1]
        rows.append([300 + k, text if k % 2 else text + " tail", "en", "src0", len(text)])
    rows += [[400, None, None, None, None], [401, "", "en", "src1", 0]]
    spark.createDataFrame([tuple(x) for x in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def plain(rows, items):
    """The same decisions, one after the other."""
    kept = [x[:2] for x in rows if not any(b in (x[1] or "") for b in BAD)]
    sets = {i: sets_of(t, 5) for i, t in kept}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    kept = [(i, t) for i, t in kept if root(i) == i]
    grams = {tuple(w[k : k + 10]) for _, t in items for w in [t.split()] for k in range(len(w) - 9)}
    kept = [(i, t) for i, t in kept if not any(tuple(w[k : k + 10]) in grams for w in [re.findall("[a-z0-9]+", t or "")] for k in range(len(w) - 9))]
    out = {}
    for i, t in kept:
        if t:
            base, guess = scan(t)
            at, text = 0, ""
            for s, e in sorted([x[:2] for x in base] + [x[:2] for x in guess]):
                if s >= at:
                    text += t[at:s] + "[REDACTED]"
                at = max(at, e)
            t = text + t[at:]
        out[i] = t
    return out


def test_pipeline(spark, tmp_path):
    rows, items = write_tables(spark, str(tmp_path))
    got = {r["doc_id"]: (list(r["ids"]), r["parity"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    model = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    assert got == {i: (model.encode(t or ""), True) for i, t in plain(rows, items).items()}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert not any("24be64439e" in (r["text"] or "") for r in corpus_pipeline.secrets(spark, docs, str(tmp_path)).collect())


def test_extra_columns_pass_the_stages(spark, tmp_path):
    rows, _ = write_tables(spark, str(tmp_path))
    extra = ["score", "spans", "row", "copy", "place", "hit", "block", "toxic", "__slot", "label", "extra_1"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", *[f"concat('{c}', doc_id) as `{c}`" for c in extra])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        for r in out.where("doc_id is not null").limit(60).collect():
            assert [r[c] for c in extra] == [f"{c}{r['doc_id']}" for c in extra]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows)


def test_pipeline_of_empty_tables(spark, tmp_path):
    write_tables(spark, str(tmp_path / "full"))
    for name, empty in (("labels", {"labels"}), ("benchmark", {"benchmark"}), ("all", {"documents", "labels", "benchmark"})):
        for table in ("documents", "labels", "benchmark"):
            df = spark.read.parquet(f"{tmp_path}/full/{table}.parquet")
            (df.limit(0) if table in empty else df.limit(40)).write.parquet(f"{tmp_path}/{name}/{table}.parquet")
        n = corpus_pipeline.run(spark, f"{tmp_path}/{name}").count()
        assert (n == 0) == (name == "all")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"create view {Path(path).stem} as select * from '{path}'")
    df = QUERIES[name](spark, SF_DIR)
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda rows, names: sorted(str([r[names.index(c)] for c in sorted(names)]) for r in rows)
    assert key(want.fetchall(), columns) == key([tuple(r) for r in df.collect()], df.columns)
