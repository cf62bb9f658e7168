import random

from fenestra.operators import matching


def test_one_to_one_is_the_pass_in_order(spark):
    rng = random.Random(8)
    row = lambda i: {"i": i, "o": rng.randint(0, 9), "a": rng.choice([None, "", *"abcdef"]), "b": rng.randint(0, 12)}
    left, right = [row(i) for i in range(40)], [row(100 + i) for i in range(30)]
    want, taken = {}, set()
    for x in sorted(left, key=lambda r: (r["o"], r["i"])):
        fits = [y for y in sorted(right, key=lambda r: (r["o"], r["i"])) if y["i"] not in taken and ((x["a"] and x["a"] == y["a"]) or x["b"] == y["b"])]
        if fits:
            want[x["i"]] = fits[0]["i"]
            taken.add(fits[0]["i"])
    schema = "{0} long, o long, a string, b long"
    df = lambda rows, name: spark.createDataFrame([(r["i"], r["o"], r["a"], r["b"]) for r in rows], schema.format(name))
    got = matching.one_to_one(df(left, "x"), df(right, "y"), "x", "y", ["a", "b"], "o", "o").collect()
    assert {r.x: r.y for r in got} == want


def test_reconcile_and_upsert(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k long, v string")
    b = spark.createDataFrame([(1, "y"), (2, None), (4, "w")], "k long, v string")
    got = {r.k: (r.reasons, r.consistent) for r in matching.reconcile(a, b, ["k"], ["v"]).collect()}
    assert got == {1: ("v_differs", False), 2: ("", True), 3: ("gone", False), 4: ("new", False)}
    assert {r.k: r.v for r in matching.upsert(a, b, ["k"]).collect()} == {1: "y", 2: None, 3: "z", 4: "w"}
