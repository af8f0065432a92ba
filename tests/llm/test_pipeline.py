import zlib
from collections import Counter

import corpus_pipeline
from vaultlens.llm import decontam, mixing, quality, queries, simhash

from .conftest import corpus
from .test_decontam import edit_distance_inside
from .test_quality import brute
from .test_simhash import brute_classes, brute_fingerprint


def test_stages_are_the_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontaminate", "mix", "shard"]
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_every_stage_takes_effect(spark, crowded, tmp_path):
    docs = crowded
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    sf_dir, kept = str(tmp_path), docs
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["quality_rules"](spark, docs, sf_dir)
    rows = kept.collect()
    assert kept.columns == docs.columns and all(brute(r.text)[0] >= 50 for r in rows)
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in quality.verdicts(docs).collect() if r.kept)

    once = stages["near_dedup"](spark, kept, sf_dir)
    classes = brute_classes({brute_fingerprint(r.text) for r in rows})
    want = {min(r.doc_id for r in rows if classes[brute_fingerprint(r.text)] == c) for c in set(classes.values())}
    assert sorted(r.doc_id for r in once.collect()) == sorted(want)

    # a passage of a document that comes this far
    first = max((r.text.split("\n")[0] for r in once.collect() if r.doc_id < 60), key=len)
    spark.createDataFrame([(1, first)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = stages["decontaminate"](spark, once, sf_dir)
    item = decontam.words(first)
    hit = {r.doc_id for r in once.collect() if edit_distance_inside(item, decontam.words(r.text)) <= len(item) // 5}
    assert {r.doc_id for r in clean.collect()} == want - hit and hit

    mix = stages["mix"](spark, clean, sf_dir)
    times = {r.doc_id: r.taken // r.size for r in mixing.mixed(clean).collect()}
    assert mix.columns == docs.columns and Counter(r.doc_id for r in mix.collect()) == +Counter(times)

    sharded = stages["shard"](spark, mix, sf_dir).collect()
    assert Counter(r.doc_id for r in sharded) == +Counter(times)
    counts = Counter(r.shard for r in sharded)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(16)) <= 1

    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(map(str, whole)) == sorted(map(str, sharded))


def test_empty_tables(spark, docs, nothing, tmp_path):
    for name, df, bench in (("none", nothing, [(1, "some words of an item here")]), ("free", docs, [])):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        have = corpus_pipeline.run(spark, str(tmp_path / name))
        assert (have.count() == 0) == (name == "none") and "shard" in have.columns


def test_query_contracts(spark, tmp_path):
    rows = corpus()
    for name, df in {
        "documents": spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"),
        "benchmark": spark.createDataFrame([(1, rows[9][1].split("\n")[0])], "item_id long, text string"),
        "pages": spark.createDataFrame([(1, "http://a.org", "<article>x</article>"), (2, None, None)], "page_id long, url string, html string"),
    }.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    have = {n: q(spark, str(tmp_path)) for n, q in queries.QUERIES.items()}
    wanted = {
        "op1_token_files": {"doc_id", "start", "n_tokens", "ids_crc32"},
        "op2_mix_sources": {"doc_id", "size", "source_size", "target", "taken"},
        "op3_simhash": {"doc_id", "fingerprint", "component_id"},
        "op4_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
        "op7_shard": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
        "op9_main_text": {"page_id", "url", "text", "n_chars"},
    }
    for name, columns in wanted.items():
        assert columns <= set(have[name].columns), name
        assert have[name].count() == (2 if name == "op9_main_text" else len(rows)), name
    kinds = dict(have["op7_shard"].dtypes)
    assert (kinds["size"], kinds["text_crc32"], kinds["shard"], kinds["slot"], kinds["grown_shard"]) == ("bigint", "bigint", "int", "bigint", "int")
    assert dict(have["op1_token_files"].dtypes)["ids_crc32"] == "bigint"
    text = {r[0]: (r[1] or "").encode() for r in rows}
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in have["op7_shard"].collect() if r.doc_id is not None)
    assert all(len(r.fingerprint) == 16 and int(r.fingerprint, 16) == brute_fingerprint(dict((x[0], x[1]) for x in rows)[r.doc_id]) for r in have["op3_simhash"].collect() if r.doc_id is not None)
    assert simhash.SHINGLE == 4
