import pytest

from tessera.llm import queries

CONVERSATIONS = [(1, 0, "user", "a"), (1, 1, None, "> a\nb"), (None, None, None, None), (1, 1, None, "> a\nb"), (2, None, "user", ""), (2, 5, "user", "> x")]
EMBEDDINGS = [(0, [1.0, 2.0], 1), (50, [0.5, None], 1), (100, [0.0, float("nan")], None), (7, [1.0, -1.0], 2), (7, [1.0, -1.0], 2), (None, [1.0, 1.0], 0), (150, None, 0), (200, [], 0), (250, [1.0], 3)]
LABELS = [(1, 1, 0), (1, 1, 0), (2, 0, 1), (4, None, None), (None, 1, 1), (9, 0, 1), (11, 1, 0), (77, 1, 0), (12, 0, 0), (12, 1, 1)]
EXTRA = ["'e' as score", "1 as n_tokens", "true as kept", "'p' as position", "0 as rank", "'v' as value", "1 as a", "2 as b", "3 as key", "4 as label"]


@pytest.fixture(scope="module", params=["odd", "empty"])
def tables(request, spark, odd, tmp_path_factory):
    path = tmp_path_factory.mktemp(request.param)
    made = {
        "documents": odd,
        "conversations": spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string"),
        "embeddings": spark.createDataFrame(EMBEDDINGS, "vec_id long, embedding array<float>, label int"),
        "labels": spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"),
    }
    for name, frame in made.items():
        own = {c.lower() for c in frame.columns}
        frame = frame.selectExpr(*[e for e in EXTRA if e.split(" as ")[1] not in own], "*")
        (frame if request.param == "odd" else frame.where("false")).write.parquet(str(path / f"{name}.parquet"))
    return request.param, str(path)


SIZES = {"op9_exact_top_k": 2, "op10_chat_formatting": 6}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, tables, rows, name):
    kind, path = tables
    got = queries.QUERIES[name](spark, path).collect()
    assert len(got) == (0 if kind == "empty" else SIZES.get(name, len(rows)))
