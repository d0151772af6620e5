"""JSON decoding with defined defaults, ids, times and vectors as text or bytes, in Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Digits of Crockford's base 32.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
BASE32 = "abcdefghijklmnopqrstuvwxyz234567"


def strings(c: Column) -> Column:
    """The strings of a JSON array; empty for null, for what is no array and for what is no JSON."""
    return F.filter(F.coalesce(F.from_json(c, "array<string>"), F.expr("cast(array() as array<string>)")), lambda x: x.isNotNull())


def objects(c: Column, schema: str, required: tuple[str, ...] = ()) -> Column:
    """The objects of a JSON array as structs, those that lack a ``required`` field left out; empty for all else."""
    found = F.coalesce(F.from_json(c, f"array<struct<{schema}>>"), F.expr(f"cast(array() as array<struct<{schema}>>)"))
    return F.filter(found, lambda x: x.isNotNull() & _all(x[r].isNotNull() for r in required))


def fields(c: Column) -> Column:
    """The fields of a JSON object as a map of JSON texts and plain strings; empty for all else."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.expr("cast(map() as map<string,string>)"))


def json_array(c: Column) -> Column:
    """The elements as a JSON array; null is an empty one."""
    return F.coalesce(F.to_json(c), F.lit("[]"))


def _all(conditions) -> Column:  # noqa: ANN001
    out = F.lit(True)
    for x in conditions:
        out &= x
    return out


def contract(c: Column, needs: dict[str, str]) -> Column:
    """What is wrong with a JSON object: "not an object", "missing NAME", "NAME is not TYPE", in the order of ``needs``.

    Types: string, number, integer, boolean, array, object; a name that ends in "?" may be missing.
    """
    kind = lambda j: F.when(j.rlike(r'^\s*"'), "string").when(j.rlike(r"^\s*(true|false)\s*$"), "boolean").when(j.rlike(r"^\s*\["), "array").when(j.rlike(r"^\s*\{"), "object").when(j.rlike(r"^\s*-?[0-9]+\s*$"), "integer").when(j.rlike(r"^\s*-?[0-9]"), "number")
    whole = F.try_parse_json(c)
    faults = [F.when(whole.isNull() | ~F.coalesce(F.schema_of_variant(whole).startswith("OBJECT"), F.lit(False)), "not an object")]
    for name, wanted in needs.items():
        key = name.removesuffix("?")
        j = F.to_json(F.try_variant_get(whole, f"$.{key}", "variant"))
        found = kind(j)
        fits = (found == wanted) | ((found == "integer") & F.lit(wanted == "number"))
        faults.append(F.when(j.isNull() & F.lit(not name.endswith("?")), f"missing {key}").when(j.isNotNull() & ~F.coalesce(fits, F.lit(False)), f"{key} is not {wanted}"))
    first = faults[0]
    rest = F.filter(F.array(*faults[1:]), lambda x: x.isNotNull())
    return F.when(first.isNotNull(), F.array(first)).otherwise(rest)


def map_of_groups(c: Column) -> Column:
    """An array of (name, members) structs as a map; a name given twice keeps its last members."""
    return F.map_from_entries(F.filter(c, lambda x: F.size(F.filter(c, lambda y: (y["name"] == x["name"]) & (F.array_position(c, y) > F.array_position(c, x)))) == 0))


@F.pandas_udf(T.BinaryType())
def vector_bytes(vectors):  # noqa: ANN001, ANN201
    """Little-endian 32-bit floats; null for null."""
    import numpy as np

    return vectors.map(lambda v: np.asarray(v, "<f4").tobytes(), na_action="ignore")


def checked_vector(c: Column, width: int) -> Column:
    """The bytes of a vector of this width, null of any other."""
    return F.when(F.size(c) == width, vector_bytes(c))


def utc_time(c: Column) -> Column:
    """An ISO-8601 text with Z or +00:00 as a time; null for any other zone, for none and for what is no time."""
    return F.when(c.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,6})?(Z|\+00:00)$"), F.try_to_timestamp(F.regexp_replace(F.regexp_replace(c, "(Z|\\+00:00)$", ""), "T", " ")))


def iso_text(c: Column) -> Column:
    """A time as ISO-8601 text in UTC, with milliseconds."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def shifted(c: Column, days: int) -> Column:
    """An ISO-8601 text so many days later."""
    return iso_text(utc_time(c) + F.make_dt_interval(F.lit(days)))


def _digits(bits: Column, alphabet: str, count: int) -> Column:
    pick = lambda i: F.substring(F.lit(alphabet), F.conv(F.substring(bits, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), pick), "")


def _bits(hexes: Column, count: int) -> Column:
    """The first hexadecimal digits as bits."""
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: F.lpad(F.conv(F.substring(hexes, i, F.lit(1)), 16, 2), 4, "0")), "")


def paper_key(user: Column, source_hash: Column) -> Column:
    """``ppr_`` and 26 digits that come from the user and the source alone: the low 130 of the digest's first 136 bits."""
    bits = _bits(F.sha2(F.concat(user, F.lit(":"), source_hash), 256), 34)
    return F.concat(F.lit("ppr_"), _digits(F.substring(bits, 7, 130), CROCKFORD, 26))


def page_key(source_hash: Column, page: Column) -> Column:
    """``pg_`` and 16 base-32 digits of the digest of source and page."""
    return F.concat(F.lit("pg_"), _digits(_bits(F.sha2(F.concat(source_hash, F.lit("|"), page.cast("string")), 256), 20), BASE32, 16))


def ulid(time: Column, chance: Column) -> Column:
    """26 digits: 48 bits of milliseconds, then 80 bits of the digest of ``chance`` (a random number where ids have to differ)."""
    millis = F.lpad(F.conv(F.unix_millis(time).cast("string"), 10, 2), 50, "0")
    return F.concat(_digits(millis, CROCKFORD, 10), _digits(_bits(F.sha2(chance.cast("string"), 256), 20), CROCKFORD, 16))


def settings_hash(settings: Column) -> Column:
    """The digest of a map as JSON with its keys in order."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(settings)))), 256)


def generation(c: Column) -> Column:
    """A generation counts from 1; anything else is null."""
    return F.when(c >= 1, c.cast("int"))


def scope_key(owner: Column, paper: Column, gen: Column) -> Column:
    return F.concat(owner, F.lit("/"), paper, F.lit("@"), gen.cast("string"))


def is_id(c: Column, prefix: str) -> Column:
    """Ids of papers (``ppr_`` and 26 Crockford digits) and blocks (``blk_`` and 16 base-32 digits)."""
    return F.coalesce(c.rlike("^ppr_[0-9A-HJKMNP-TV-Z]{26}$" if prefix == "ppr_" else f"^{prefix}[a-z2-7]{{16}}$"), F.lit(False))
