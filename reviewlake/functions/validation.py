"""What is wrong with a JSON text held against a form, as an array of (path, reason).

The text is read once as a VARIANT and the form is walked in one column expression, nested forms inside their lists, so that a
row with many faults lists all of them. Reasons are the published type names of the validation library whose models the forms
stand for: json_invalid, model_type, missing, string_type, list_type, int_type, int_parsing, greater_than_equal, less_than_equal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlake.functions.decisions import score_prefix
from reviewlake.operators.reviews import NESTED, Field

FAULT = "array<struct<path:string,reason:string>>"


def _fault(path: Column, reason: str | Column) -> Column:
    return F.array(F.struct(path.alias("path"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason")))


def _none() -> Column:
    return F.array().cast(FAULT)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _texts(v: Column, path: Column) -> Column:
    """Elements that aren't texts."""
    each = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: F.when(_kind(x) != "STRING", F.struct(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")).alias("path"), F.lit("string_type").alias("reason"))))
    return F.array_compact(each)


def _objects(v: Column, path: Column, form: tuple[Field, ...]) -> Column:
    """Faults of the elements, each held against a nested form."""
    return F.flatten(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: _object(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), form)))


def _score(v: Column, path: Column, bounds: tuple[int, int]) -> Column:
    """A whole number, or a text that begins with one."""
    n = F.when(_kind(v) == "STRING", score_prefix(F.try_variant_get(v, "$", "string"))).otherwise(F.try_variant_get(v, "$", "int"))
    reason = F.when(n < bounds[0], "greater_than_equal").when(n > bounds[1], "less_than_equal")
    return F.when(~_kind(v).isin("STRING", "BIGINT"), _fault(path, "int_type")).when(n.isNull(), _fault(path, "int_parsing")).when(reason.isNotNull(), _fault(path, reason)).otherwise(_none())


def _object(v: Column, path: Column, form: tuple[Field, ...]) -> Column:
    return F.when(F.startswith(_kind(v), F.lit("OBJECT<")), F.concat(*[_field(v, path, f) for f in form])).otherwise(_fault(path, "model_type"))


def _field(whole: Column, path: Column, f: Field) -> Column:
    at = F.concat(path, F.when(path != "", ".").otherwise(""), F.lit(f.key or f.name))
    get = lambda name: F.try_variant_get(whole, f"$['{name}']", "variant")
    v = F.coalesce(get(f.key), get(f.name)) if f.key else get(f.name)
    kind = _kind(v)
    if f.kind == "int":
        found = _score(v, at, f.bounds)
    elif f.kind in ("str", "optional"):
        good = (kind == "STRING") | (kind == "VOID") if f.kind == "optional" else kind == "STRING"
        found = F.when(good, _none()).otherwise(_fault(at, "string_type"))
    else:
        inner = _objects(v, at, NESTED[f.kind]) if f.kind in NESTED else _texts(v, at)
        found = F.when(F.startswith(kind, F.lit("ARRAY<")), inner).otherwise(_fault(at, "list_type"))
    return F.when(v.isNull(), _fault(at, "missing") if f.required else _none()).otherwise(found)


def form_faults(text: Column, form: tuple[Field, ...]) -> Column:
    """The faults of a JSON text, in the order of the form's fields; empty if it fits, one json_invalid if it is null or no JSON."""
    v = F.try_parse_json(text)
    return F.when(v.isNull(), _fault(F.lit(""), "json_invalid")).otherwise(_object(v, F.lit(""), form))
