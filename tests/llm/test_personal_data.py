"""What personal data is learned from."""

import random

from pyspark.sql import functions as F

from saldo.llm import pii


def test_all_documents_are_learned_from(spark):
    rng = random.Random(8)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = []
    for i in range(500):
        texts.append(f"please call +1 ({number(3)}) 555-{number(4)} today number {i}")
        texts.append(f"order {number(12)} was shipped, item {i} of {number(9)}")
    plain = [f"see @ number {i}" for i in range(9_000)]
    # Texts without a candidate come first by their digests, more of them than a sample of 4000 holds.
    given = spark.createDataFrame([(x, True) for x in texts] + [(x, False) for x in plain], "text string, holds boolean")
    given = given.where("holds = (xxhash64(text) > 0)").select("text").cache()
    assert given.where("text LIKE 'see%'").count() > 4_000
    model = pii.fit(given)
    assert model.thresholds[pii.KINDS.index("phone")] is not None
    new = spark.createDataFrame([("please call 1 (743) 555-3824 today",)], "text string")
    assert pii.with_spans(new, model).select(pii.as_text(F.col("_spans"))).first()[0] == "phone:12:28"
    # Every candidate counts, equal texts once.
    numbers = given.where("text LIKE 'please%'")
    counted = pii.examples(numbers.unionByName(numbers)).where("label = 1").agg(F.sum("n")).first()[0]
    assert counted >= numbers.count() > 100
    assert counted == pii.examples(numbers).where("label = 1").agg(F.sum("n")).first()[0]


def test_scores_by_arrays_are_those_of_the_trees(spark):
    score = "1.0D * IF(f[2] <= 4.5D, IF(f[0] <= 1.0D, -0.5D, 0.25D), 0.75D) + 0.1D * -0.3D + 0.1D * IF(f[1] <= 2.5D, 1e-05D, 3.0D)"
    rows = spark.createDataFrame([([float(a), float(b), float(c)],) for a in range(3) for b in range(5) for c in range(3, 7)], "f array<double>")
    got = rows.select(pii._scored(score, F.col("f")).alias("a"), F.expr(score).alias("b")).collect()
    assert [r for r in got if abs(r.a - r.b) > 1e-12] == []
    assert len({r.a for r in got}) == 6
