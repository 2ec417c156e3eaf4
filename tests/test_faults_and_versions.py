"""JSON against forms (held to the validation library itself), failed rows as data, and tables whose parts are replaced at once."""

import json
import random

import pydantic
import pytest
from pyspark.sql import functions as F

from reviewlake.functions import validation as V
from reviewlake.operators import attempts as A
from reviewlake.operators import reviews as R
from reviewlake.sources import versions as T


def model_of(form):
    """The form as a model of the library."""
    def kind(f):
        if f.kind in R.NESTED:
            return (list[model_of(R.NESTED[f.kind])], [])
        return {"str": (str, ...), "optional": (str | None, None), "list": (list[str], [])}[f.kind]

    return pydantic.create_model("Form", **{f.name: kind(f) for f in form})


def faults_of(model, text):
    try:
        model.model_validate(json.loads(text))
        return []
    except json.JSONDecodeError:
        return [("", "json_invalid")]
    except pydantic.ValidationError as e:
        path = lambda loc: "".join(f"[{x}]" if isinstance(x, int) else f".{x}" for x in loc).lstrip(".")
        return [(path(x["loc"]), x["type"]) for x in e.errors()]


def test_form_faults(spark):
    rng = random.Random(17)
    some = lambda: rng.choice(["text", "", "é\\n", 5, 5.5, True, None, [], ["a"], ["a", None, 3], {}, {"ref": "r"}, [{"ref": "r", "within": "s"}], [{"ref": 1, "within": None, "x": 2}, {}, "s", None], [["a"]]])
    texts = ["", "no", "[1]", '"x"', "null", "5", "{}", '{"summary": "s"'] + [json.dumps({f.name: "fine" if rng.random() < 0.5 else some() for f in R.UNIVERSAL_REVIEW if rng.random() < 0.85} | {"other": some()}) for _ in range(150)]
    for form in (R.UNIVERSAL_REVIEW, R.UNIVERSAL_META):
        model = model_of(form)
        got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", V.form_faults(F.col("t"), form).alias("f")).collect()
        for r in got:
            assert [tuple(x) for x in r.f] == faults_of(model, r.t), r.t
    none = spark.range(1).select(V.form_faults(F.lit(None).cast("string"), R.UNIVERSAL_META).alias("f")).first().f
    assert [tuple(x) for x in none] == [("", "json_invalid")]


def test_form_scores_and_other_names(spark):
    form = (R.Field("rating", "int", bounds=(1, 10)), R.Field("clarity", key="clarity,_quality"))
    texts = {'{"rating": "5: fair", "clarity": "x"}': [], '{"rating": 11, "clarity,_quality": "x"}': [("rating", "less_than_equal")], '{"rating": "0", "clarity,_quality": 1}': [("rating", "greater_than_equal"), ("clarity,_quality", "string_type")], '{"rating": "fair"}': [("rating", "int_parsing"), ("clarity,_quality", "missing")], '{"rating": [5], "clarity": "x"}': [("rating", "int_type")]}
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", V.form_faults(F.col("t"), form).alias("f")).collect():
        assert [tuple(x) for x in r.f] == texts[r.t], r.t


def test_failed_rows_are_data(spark, tmp_path):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["4", "x", None, "0", "8"])], "id int, t string").repartition(2)
    def eighth(t):
        return 8 // int(t)

    tried = rows.withColumn("r", A.attempt(eighth, "int", F.col("t"), when=F.col("t").isNotNull()))
    both = A.with_outcome(tried, [("text", F.when(F.col("t").isNull(), "no text")), ("divide", F.col("r.error"))])
    path = str(tmp_path / "both")
    assert A.write_both(both, path) == {"good": 2, "failed": 3}
    good = {r.id: r.r.value for r in A.read_outcome(spark, path, "good", both).collect()}
    bad = {r.id: (r.stage, r.error.partition(":")[0]) for r in A.read_outcome(spark, path, "failed", both).collect()}
    assert good == {0: 2, 4: 1} and bad == {1: ("divide", "ValueError"), 2: ("text", "no text"), 3: ("divide", "ZeroDivisionError")}
    fine = both.filter("id = 0")
    assert A.write_both(fine, path) == {"good": 1, "failed": 0} and A.read_outcome(spark, path, "failed", both).count() == 0


def test_parts_are_replaced_at_once(spark, tmp_path):
    root, schema = str(tmp_path / "t"), "year int, id string"
    make = lambda *rows: spark.createDataFrame(list(rows), schema)
    read = lambda *a, **k: sorted(map(tuple, T.read_parts(spark, root, schema, *a, **k).collect()))
    assert read() == [] and T.replace_parts(make((2020, "a"), (2021, "b"), (2021, "c")), root, "year") == 1
    assert T.replace_parts(make((2020, "x"), (2022, "y")), root, "year") == 2
    assert read() == [(2020, "x"), (2021, "b"), (2021, "c"), (2022, "y")] and read([2021]) == [(2021, "b"), (2021, "c")] and read(number=1)[0] == (2020, "a")
    broken = make((2020, "z")).withColumn("id", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        T.replace_parts(broken, root, "year")
    assert read()[0] == (2020, "x") and T.last_commit(spark, root)[0] == 2  # the old rows stay
    with pytest.raises(T.Conflict):
        T._commit(spark, root, 2, {})
    assert T.replace_parts(make((2021, "n")), root, "year", [2020, 2021]) == 3  # 2020 has no rows any more
    assert read() == [(2021, "n"), (2022, "y")]
    assert T.expire(spark, root) >= 3 and read() == [(2021, "n"), (2022, "y")]
