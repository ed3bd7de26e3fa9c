"""Leaks against plain Python."""

import random

from plateworks.plans import catalogue


def test_leaks_in_all_documents(spark, tmp_path):
    rnd = random.Random(1)
    text = lambda n: ".".join(rnd.choice("abcdefgh") for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 3, 20, 21, 40, 60])] + [(6, None)]
    docs = [(i, "s", text(rnd.choice([1, 3, 20, 21, 40]))) for i in range(60)]
    for i, (_, t) in enumerate(items[2:6]):
        for changed in (0, 20, 21):
            lines = t.split(".")
            docs.append((100 + 10 * i + changed % 7, "s", ".".join("z" * (k < changed) or x for k, x in enumerate(lines))))
    docs.append((999, "s", None))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def leak(a, b):
        a, b = a.split("."), b.split(".")
        return len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) <= max(20, len(a) // 200)

    want = {i: sum(leak(t, d) for _, _, d in docs if d is not None) if t is not None else 0 for i, t in items}
    assert {r.item_id: r.n_leaks for r in catalogue.queries()["leak_positional_all"](spark, str(tmp_path)).collect()} == want
