from codeloom.operators import context


def test_bindings_of_one_name_are_parted_and_not_shuffled(spark, rows):
    functions = spark.createDataFrame([("Function", f"p.f{i % 200}", "same") for i in range(400)] + [("Method", "p.C.other", "other"), ("Class", "p.same", "same"), ("Function", "p.null", None)], "label string, qn string, name string")
    bindings = spark.createDataFrame([("p.f0", "same"), ("p.f0", "same"), ("b.x", "other"), ("b.none", "none"), ("b.null", None)], "qn string, simple_name string")
    made = context.binding_edges(bindings, functions)
    assert rows(made, "src", "dst") == sorted([("p.f0", f"p.f{i}") for i in range(1, 200)] + [("b.x", "p.C.other")])
    above = made._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "Aggregate" not in above
