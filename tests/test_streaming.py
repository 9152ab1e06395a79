import pytest

from tessera.engine import Engine
from tessera.errors import WrongCommand
from tessera.streaming.queries import start, stream


def test_select_over_a_stream(spark, tmp_path):
    spark.range(20).selectExpr("id", "id % 3 as part").write.parquet(str(tmp_path / "in"))
    engine = Engine(spark)
    engine.register("s", spark.readStream.schema("id long, part long").parquet(str(tmp_path / "in")))
    engine.register("names", spark.createDataFrame([(0, "zero"), (1, "one")], "part long, name string"))
    q = start(engine, "select s.id, n.name from s join names as n on s.part = n.part where s.id > 9", "memory", str(tmp_path / "cp"), queryName="found")
    q.processAllAvailable()
    q.stop()
    assert spark.table("found").count() == sum(i % 3 < 2 for i in range(10, 20))
    q = start(engine, "select part, count(*) as n from s group by part", "memory", str(tmp_path / "cp2"), mode="complete", queryName="counts")
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("counts").collect()} == {(0, 7), (1, 7), (2, 6)}
    with pytest.raises(WrongCommand):
        stream(engine, "select id from s limit 3")
    with pytest.raises(WrongCommand):
        stream(engine, "select name from names")
