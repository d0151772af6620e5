"""Texts with proposed repairs, spans and alternatives as nested columns: reading them, and what is wrong with them.

repairs: array of structs (kind, at, from_text, to_text, applied, model, prompt_hash); spans: array of structs (start, end,
text); alternatives: array of structs (selected, …).  Offsets count characters from 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REPAIR = "kind string, at int, from_text string, to_text string, applied boolean, model string, prompt_hash string"


def _slice(text: Column, start: Column, length: Column) -> Column:
    return F.substring(text, start + 1, length)


def _numbered(c: Column) -> Column:
    return F.transform(c, lambda x, i: F.struct(i.cast("int").alias("i"), x.alias("r")))


def resolved(text: Column, repairs: Column, apply_proposed: bool = False) -> Column:
    """The text with the proposals (repairs not applied yet) folded in: ``text``, ``taken`` (their numbers) and ``skipped``
    (number and reason), both in order.

    From the last offset backwards; one that does not stand where it says is skipped with a reason and nothing is guessed:
    not_requested, no_text, missing_offset, offset_out_of_range, text_mismatch, conflicting_range.  Null repairs are none.
    """
    none = F.expr("cast(array() as array<int>)")
    waiting = F.filter(_numbered(F.coalesce(repairs, F.from_json(F.lit("[]"), f"array<struct<{REPAIR}>>"))), lambda x: ~F.coalesce(x["r"]["applied"], F.lit(False)))
    skip_all = lambda why: F.struct(F.coalesce(text, F.lit("")).alias("text"), none.alias("taken"), F.transform(waiting, lambda x: F.struct(x["i"].alias("i"), F.lit(why).alias("reason"))).alias("skipped"))
    if not apply_proposed:
        return skip_all("not_requested")
    order = F.array_sort(F.transform(waiting, lambda x: F.struct((-F.coalesce(x["r"]["at"], F.lit(-1))).alias("k"), (-x["i"]).alias("n"), x["i"].alias("i"), x["r"].alias("r"))))
    start = F.struct(text.alias("text"), F.expr("cast(array() as array<struct<at:int,end:int,i:int>>)").alias("done"), F.expr("cast(array() as array<struct<i:int,reason:string>>)").alias("skipped"))

    def step(s: Column, x: Column) -> Column:
        at, length = x["r"]["at"], F.length(x["r"]["from_text"])
        end = (at + length).cast("int")
        clash = F.exists(s["done"], lambda d: ((at < d["end"]) & (d["at"] < end)) | ((at == end) & (d["at"] == d["end"]) & (at == d["at"])))
        why = F.when(at.isNull(), "missing_offset").when(end > F.length(text), "offset_out_of_range").when(_slice(text, at, length) != x["r"]["from_text"], "text_mismatch").when(clash, "conflicting_range")
        put = F.concat(F.left(s["text"], at), x["r"]["to_text"], F.substring(s["text"], end + 1, F.length(s["text"])))
        return F.struct(
            F.when(why.isNull(), put).otherwise(s["text"]).alias("text"),
            F.when(why.isNull(), F.concat(s["done"], F.array(F.struct(at.alias("at"), end.alias("end"), x["i"].alias("i"))))).otherwise(s["done"]).alias("done"),
            F.when(why.isNull(), s["skipped"]).otherwise(F.concat(s["skipped"], F.array(F.struct(x["i"].alias("i"), why.alias("reason"))))).alias("skipped"))

    folded = F.aggregate(order, start, step)
    done = F.struct(folded["text"].alias("text"), F.transform(F.array_sort(folded["done"]), lambda d: d["i"]).alias("taken"), F.array_sort(folded["skipped"]).alias("skipped"))
    return F.when(text.isNull(), skip_all("no_text")).otherwise(done)


def spans_in_text(text: Column, spans: Column) -> Column:
    """Each span lies within the text and holds what stands there; true for no spans."""
    return F.forall(F.coalesce(spans, F.array()), lambda s: F.coalesce((s["start"] >= 0) & (s["end"] >= s["start"]) & (s["end"] <= F.length(text)) & (_slice(text, s["start"], s["end"] - s["start"]) == s["text"]), F.lit(False)))


def spans_ascend(spans: Column) -> Column:
    """Spans come in order and none overlaps the one before."""
    return F.forall(F.zip_with(F.slice(spans, F.lit(1), F.greatest(F.size(spans) - 1, F.lit(0))), F.slice(spans, F.lit(2), F.greatest(F.size(spans) - 1, F.lit(0))), lambda a, b: b["start"] >= a["end"]), lambda ok: ok)


def repairs_fit(text: Column, repairs: Column) -> Column:
    """Each repair names a place in the text: one not applied yet what it replaces, one applied what it put there."""
    stands = lambda r: F.when(r["applied"], r["to_text"]).otherwise(r["from_text"])
    return F.forall(F.coalesce(repairs, F.array()), lambda r: F.coalesce((r["at"] >= 0) & (_slice(text, r["at"], F.length(stands(r))) == stands(r)), F.lit(False)))


def model_repairs_told(repairs: Column) -> Column:
    """A repair by a model names it and the prompt, and is not applied."""
    return F.forall(F.coalesce(repairs, F.array()), lambda r: (r["kind"] != "model") | (r["model"].isNotNull() & r["prompt_hash"].isNotNull() & ~F.coalesce(r["applied"], F.lit(False))))


def one_selected(alternatives: Column) -> Column:
    """At most one alternative is selected."""
    return F.size(F.filter(F.coalesce(alternatives, F.array()), lambda a: F.coalesce(a["selected"], F.lit(False)))) <= 1
