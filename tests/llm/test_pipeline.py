import corpus_pipeline
from graphloom.llm import decontaminate, minhash, pieces, quality, secrets

GOOD = "The text number {} reads well, with some words in it. It ends here, on line {}.\n"


def write(spark, folder):
    docs, labels = [], []
    for k in range(200):
        junk = k % 10 == 0
        docs.append((k, "BUY!! NOW$$$ CHEAP%%% WIN&&& {}\n".format(k) * (3 + k // 10 % 12) if junk else "".join(GOOD.format(k, k * 31 + j) for j in range(3 + k % 12)), "en", "src", 0))
        if k % 2 == 0:
            labels.append((k, int(not junk), 0))
    lines = lambda at: "".join(GOOD.format(at + j, at * 7 + j) for j in range(6))
    docs += [(1000, lines(2000), "en", "a", 0), (1001, lines(2000).replace("reads", "feels", 1), "en", "b", 0), (1002, lines(3000) + "Then token = abcdefgh12345678 follows.\n" + lines(4000), "en", "c", 0)]
    passage = "The river house stands near a quiet green hill where old friends often walk together after supper."
    docs += [(1003, lines(5000) + passage + "\n" + lines(6000), "en", "d", 0), (1004, None, "en", "e", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_take_effect(spark, tmp_path):
    folder = f"file://{tmp_path}"
    write(spark, folder)
    docs = given = spark.read.parquet(f"{folder}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        after[name] = {r.doc_id: r for r in docs.collect()}
        if name == "quality_classifier":  # the later stages are tested on every text that isn't junk
            docs = given.where("doc_id >= 200 or doc_id % 10 <> 0")
    names = [n for n, _ in corpus_pipeline.STAGES]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(list(next(iter(after[n].values())).asDict()) == columns for n in names[:-1])
    kept = after[names[0]]
    assert not [k for k in range(0, 200, 10) if k in kept] and sum(k in kept for k in range(200)) >= 150
    assert 1000 in after[names[1]] and 1001 not in after[names[1]]
    assert 1003 in after[names[1]] and 1003 not in after[names[2]]
    assert "[assign]" in after[names[3]][1002].text and "abcdefgh" not in after[names[3]][1002].text
    assert all(r.lossless for r in after[names[4]].values()) and set(after[names[4]]) == set(after[names[3]])


def test_run_applies_the_stages(spark, tmp_path):
    folder = f"file://{tmp_path}"
    write(spark, folder)
    got = {r.doc_id: r.n_pieces for r in corpus_pipeline.run(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = quality.accepted(docs, quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    want = minhash.dedup(want)
    want = secrets.redact(decontaminate.decontaminate(want, spark.read.parquet(f"{folder}/benchmark.parquet")))
    assert got == {r.doc_id: r.n_pieces for r in pieces.encode(want).collect()}


def test_empty_documents(spark, tmp_path):
    folder = f"file://{tmp_path}"
    write(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0
