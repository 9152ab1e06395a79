import base64
from hashlib import sha256

import corpus_pipeline
import numpy as np
import public_tokenizers
import tiktoken
from brute import cleaned, draws, near_classes

from tessera.llm import mixing, quality
from tessera.llm.common import durable, table
from tessera.llm.queries import MIN_SITES


def test_run_equals_plain_steps(spark):
    data = "/root/testdata/sf0.001"
    docs, labels = table(spark, data, "documents"), table(spark, data, "labels")
    model = quality.trained(docs, labels, 0.7)
    rows = {r.doc_id: r for r in docs.collect()}
    good = [i for i, r in rows.items() if model.scores([r.text.encode()])[0] >= 0.7]
    text = cleaned([(i, rows[i].text, rows[i].source) for i in good], MIN_SITES)
    ids = sorted(good)
    of = near_classes([text[i] for i in ids], 5, 0.8)
    single = [i for n, i in enumerate(ids) if of[n] == n]
    chance = draws([(i, text[i], rows[i].source, rows[i].lang) for i in single], mixing.POWER, 42)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: encoding.encode_ordinary(text[i]) for i in single if chance[i][2]}
    got = corpus_pipeline.run(spark, data).collect()
    assert {r.doc_id: list(r.token_ids) for r in got} == want and len(got) == len(want) > 20
    for r in got:
        assert r.n_tokens == len(want[r.doc_id]) and r.decoded_sha256 == sha256(text[r.doc_id].encode()).hexdigest()
        assert r.ids_sha256 == sha256(np.array(want[r.doc_id], "<u4").tobytes()).hexdigest()


def test_stages_return_documents(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found = durable(stage(spark, docs, str(tmp_path)))
        if number < len(corpus_pipeline.STAGES) - 1:
            assert found.columns == odd.columns
        empty = stage(spark, docs.where("false"), str(tmp_path))
        assert empty.count() == 0
        docs = found
    assert docs.count()
