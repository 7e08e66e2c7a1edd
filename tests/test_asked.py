from tidemill.operators import replies as R


def test_asked_holds_few_prompts_at_once(spark, monkeypatch):
    """Prompts are told apart by slices of a batch; a whole batch is never a frame of Python objects."""
    monkeypatch.setattr(R, "AT_ONCE", 2)
    rows = spark.createDataFrame([(i, [f"k{i}"], None if i == 4 else f"p{i}") for i in range(7)], "batch long, keys array<string>, prompt string").coalesce(1)

    def ask(prompt):
        if prompt == "p3":
            raise TimeoutError
        return None if prompt is None else prompt.upper()

    out = R.asked(rows, ask)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    assert sorted(map(tuple, out.collect()), key=lambda r: r[0]) == [(i, [f"k{i}"], None if i == 4 else f"p{i}", None if i in (3, 4) else f"P{i}") for i in range(7)]
    assert out.columns == ["batch", "keys", "prompt", "reply"] and R.asked(rows.limit(0), ask).collect() == []
