"""The pipeline's stages on the smallest tables, each against a plain version of its decision."""

import corpus_pipeline as p
from pyspark.sql import functions as F
from spanvec.llm import mixing, quality_classifier, secrets, simhash
from spanvec.llm._common import documents, written
from spanvec.llm.queries import id_remainder, tokenizer
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = documents(spark, SF)
    columns = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality_classifier.classify(docs, labels, id_remainder(4) == 2).collect() if r.score >= p.KEEP}
    for name, stage in p.STAGES:
        before, out = docs, written(stage(spark, docs, SF), name)
        rows = out.collect()
        if name != "bpe_encode":
            assert out.columns == columns and rows
        if name == "quality_classifier":
            assert {r.doc_id for r in rows} == good
        elif name == "simhash_near_dedup":
            assert {r.doc_id for r in rows} == {r.component_id for r in simhash.near_duplicates(before).collect()} and len(rows) == len({r.doc_id for r in rows})
        elif name == "secret_scan":
            assert len(rows) == before.count() and all(r.n_chars == len(r.text) for r in rows)
            assert secrets.scan(out).where("n_hex > 0").count() == 0
        elif name == "mix_sources":
            want = {r.doc_id: round(r.taken / r.size) for r in mixing.mix(before).collect() if r.size}
            assert {i: sum(r.doc_id == i for r in rows) for i in want} == want
        else:
            t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
            texts = {r.doc_id: r.text for r in before.collect()}
            assert len(rows) == before.count() and all(r.ids == t.encode(texts[r.doc_id], add_special_tokens=False).ids for r in rows)
        docs = out


def test_stages_with_odd_rows(spark):
    """Null ids, texts and other columns, repeated rows, empty and long texts, and columns named like those inside."""
    docs = documents(spark, SF)
    columns = docs.columns
    one = docs.limit(40)
    odd = one.unionByName(one.limit(5)).unionByName(one.limit(8).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(one.limit(3).withColumn("doc_id", F.lit(3).cast("long")))
    odd = odd.unionByName(one.limit(2).withColumn("text", F.lit(None).cast("string"))).unionByName(one.limit(2).withColumn("text", F.lit(""))).unionByName(one.limit(1).withColumn("text", F.repeat(F.lit("long words run on. "), 50_000)))
    odd = odd.unionByName(one.limit(6).withColumns({"source": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")}))
    clash = ("d", "k1", "copies", "all_spans", "fp", "n", "row", "size", "score", "taken", "mean", "owner", "begin")
    odd = written(odd.withColumns({c: F.lit("own") for c in clash}), "odd")
    for name, stage in p.STAGES[:-1]:
        out = written(stage(spark, odd, SF), name)
        assert out.columns == [*columns, *clash] and all(r[c] == "own" for r in out.collect() for c in clash)
        assert stage(spark, odd.limit(0), SF).count() == 0
        before, after = ({(r.doc_id, r.source) for r in x.collect()} for x in (odd, out))
        assert after <= before and after
        odd = out
    coded = p.STAGES[-1][1](spark, odd, SF)
    assert coded.count() == odd.count() and p.STAGES[-1][1](spark, odd.limit(0), SF).count() == 0


def test_run_leaves_the_last_stage_only(spark):
    out = p.run(spark, SF)
    assert out.count() > 0 and out.columns == ["doc_id", "source", "n_tokens", "ids"]
