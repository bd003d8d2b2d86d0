import hashlib
import random

import corpus_pipeline
from test_line_dedup import plain as plain_lines
from test_mixing import plain_copies
from test_near_copies import plain_kept
from test_toxicity import BAD, corpus

from calendrix.llm import decontaminate, mixing, toxicity


def test_run_matches_brute_force(spark, tmp_path):
    rng = random.Random(8)
    base, labels = corpus(900)
    leak = " ".join(f"bench{rng.randrange(99)}" for _ in range(30))
    rows = [(i, text + "\n" + ("Shared footer" if i % 2 else f"own {i}"), "en", f"src{i % 3}", len(text)) for i, text in base]
    rows += [(1000 + i, base[i + 1][1].replace("kan", "kan", 1) + "\nown", "en", "src0", 1) for i in (1, 3, 6)]
    rows += [(2000, f"clean text before. {leak} and after it", "en", "src1", 1), (2001, None, "en", None, None), (2002, "", "en", "src2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == [*docs.columns, "copy_no", "mix_key"]

    model = toxicity.train(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    scores = dict(zip([r[0] for r in rows], model.scores([r[1] or "" for r in rows])))
    kept = [r for r in rows if scores[r[0]] < 0.7]
    toxic = {r[0] for r in rows if any(b in (r[1] or "") for b in BAD)}
    assert len(toxic & {r[0] for r in kept}) < 0.05 * len(toxic) and {r[0] for r in rows} - toxic <= {r[0] for r in kept}
    digests = {i: h for i, _, _, h in plain_lines([(r[0], r[1]) for r in kept], 10)}
    lines = {}
    for i, text, *_ in kept:
        own = [x for x in (text or "").split("\n")]
        for mask in [own, [x for x in own if x != "Shared footer"]]:
            if hashlib.sha256("\n".join(mask).encode()).hexdigest() == digests[i]:
                lines[i] = "\n".join(mask)
    assert len(lines) == len(kept)
    kept_ids, _ = plain_kept(sorted(lines.items()))  # one of each group at 0.8 or more in five-word shingles
    lines = {i: t for i, t in lines.items() if i in kept_ids}
    assert 2000 in lines and 2001 in lines and 2002 not in lines
    lines = {i: t for i, t in lines.items() if decontaminate.normalise(leak) not in decontaminate.normalise(t)}
    source = {r[0]: r[3] for r in rows}
    size = {}
    for i, t in lines.items():
        size[source[i]] = size.get(source[i], 0) + max(1, len(t))
    weight = {s: corpus_pipeline.MIX_WEIGHTS.get(s, 1.0) for s in size}
    want = []
    for i, t in lines.items():
        rate = weight[source[i]] / sum(weight.values()) * sum(size.values()) / size[source[i]]
        want += [(i, t, source[i], len(t), c) for c in range(1, plain_copies(rate, i, mixing.SEED) + 1)]
    assert sorted((r.doc_id, r.text, r.source or "", r.n_chars, r.copy_no) for r in got.collect()) == sorted((i, t, s or "", n, c) for i, t, s, n, c in want)


def test_stages_take_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()


CLASHING = ["others", "own_id", "own_hash", "whole", "parts", "h1", "l_id", "dropped_at", "digest", "o_id", "o_digest", "root", "node", "copies", "pieces", "table", "own_source", "salt", "score", "y"]


def test_columns_of_any_name_pass_through(spark, tmp_path):
    rows = [(i, f"text number {i} of its own\nand a second line {i}", f"src{i % 2}") for i in range(40)] + [(100, None, None), (101, "", "src0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'en' AS lang", "length(text) AS n_chars", *[f"concat('{c}', doc_id) AS {c}" for c in CLASHING])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "no such passage in any of these texts")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == [*docs.columns, "copy_no", "mix_key"]
    out = got.collect()
    assert out and all(r[c] == f"{c}{r.doc_id}" for r in out for c in CLASHING)


def test_text_columns_of_another_case_and_checkpoints_of_a_run(spark):
    docs = spark.createDataFrame([(1, "vlorg GRUMPF"), (2, None)], "doc_id long, TEXT string")
    bench = spark.createDataFrame([(1, "no such passage in any of these texts")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()} == {1, 2}
    assert toxicity.without_toxic(docs, toxicity.Model(toxicity.np.zeros(0, "uint64"), toxicity.np.zeros(0), 0.0, constant=0.0)).count() == 2
