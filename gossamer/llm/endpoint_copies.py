"""Records whose endpoints differ only in white space, case, punctuation or field order.

An endpoint is the multiset {(path, p), (query, f1), (query, f2), ...} of its
normalised parts.  Each pair is hashed and the hashes are added, so the
fingerprint does not depend on the order and nothing is sorted.  Two sums give
128 bits; the fields of every member are still compared with those of its
group's first record, and records that only share the fingerprint are grouped by
the fields themselves.

Defined results: null and blank endpoints are in no group; a result delivered
twice counts once; the first record is the smallest result_id; percent signs that
start no escape stand for themselves, bytes that are no UTF-8 for U+FFFD.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.plans.staging import salted_join, stage


#: White space of any kind, no-break blanks too.
BLANKS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def plain(part: Column) -> Column:
    """Escapes decoded, lower-cased, only letters and digits kept."""
    safe = F.regexp_replace(part, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.regexp_replace(F.lower(F.coalesce(F.try_url_decode(safe), part)), r"[^\p{L}\p{N}]+", "")


def with_fields(df: DataFrame, endpoint: str = "endpoint") -> DataFrame:
    """Adds path and fields (the non-empty normalised query fields, repeats kept)."""
    e = F.col(endpoint)
    at = F.locate("?", e)
    path = F.when(at > 0, F.substring(e, F.lit(1), at - 1)).otherwise(e)
    query = F.when(at > 0, F.substring(e, at + 1, F.length(e))).otherwise(F.lit(""))
    fields = F.filter(F.transform(F.split(query, "&"), plain), lambda f: f != "")
    return df.withColumns({"path": plain(path), "fields": fields})


def fingerprint(bits: int = 64) -> tuple[Column, Column]:
    """Two commutative sums over the hashed (name, value) pairs; fewer bits only to test collisions."""
    mask = F.lit(-1 if bits >= 64 else (1 << bits) - 1)

    def total(seed: str) -> Column:
        # products and sums wrap on purpose: shift keeps 62-bit terms and the sum is taken in two halves
        lo = F.aggregate("fields", F.xxhash64(F.lit(seed), F.lit("path"), F.col("path")).bitwiseAND(F.lit((1 << 31) - 1)), lambda a, f: (a + F.xxhash64(F.lit(seed), F.lit("query"), f).bitwiseAND(F.lit((1 << 31) - 1))))
        hi = F.aggregate("fields", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("path"), F.col("path")), 33), lambda a, f: (a + F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("query"), f), 33)))
        return F.shiftleft(hi, 32).bitwiseXOR(lo).bitwiseAND(mask)

    return total("a"), total("b")


def _same_fields(f: Column, g: Column) -> Column:
    """Multiset equality without sorting: equal sizes and sets, and equal counts where fields repeat."""
    sets = (F.size(f) == F.size(g)) & (F.size(F.array_except(f, g)) == 0) & (F.size(F.array_except(g, f)) == 0)
    once = F.size(F.array_distinct(f)) == F.size(f)
    counts = F.forall(F.array_distinct(f), lambda x: F.size(F.filter(f, lambda y: y == x)) == F.size(F.filter(g, lambda y: y == x)))
    return F.when(~sets, F.lit(False)).when(once, F.lit(True)).otherwise(counts)


def copy_groups(results: DataFrame, bits: int = 64, heavy: int = 1_000_000) -> DataFrame:
    """(first_id, result_id, copies) of every record that shares its endpoint with another, the first one included."""
    e = results.select("result_id", F.col("request.endpoint").alias("endpoint")).filter("result_id is not null").filter(F.regexp_replace("endpoint", BLANKS, "") != "")
    one, two = fingerprint(bits)
    rows = with_fields(e).withColumns({"f1": one, "f2": two}).withColumn("fp", F.struct("f1", "f2")).select("fp", "result_id", "path", "fields")
    first = rows.groupBy("fp").agg(F.min("result_id").alias("first_id"), F.max("result_id").alias("last_id"), F.count(F.lit(1)).alias("weight")).filter("last_id > first_id")
    first = stage(first.select("fp", "first_id", "weight"), "first")
    members = salted_join(rows, first, "fp", "weight", heavy)
    heads = members.filter("result_id = first_id").select("fp", F.struct("path", "fields").alias("head"), "weight").distinct()  # one a group, at most a part of the groups' rows
    j = salted_join(members.drop("weight"), stage(heads, "heads"), "fp", "weight", heavy)
    ok = (F.col("path") == F.col("head.path")) & _same_fields(F.col("fields"), F.col("head.fields"))
    j = stage(j.select("result_id", "first_id", "path", "fields", ok.alias("ok")), "verified")
    good = j.filter("ok").select("first_id", "result_id").distinct()
    bad = j.filter("not ok").join(good.select("result_id"), "result_id", "left_anti")
    if not bad.isEmpty():  # the fingerprint alone was equal: group these by their fields
        counted = F.transform(F.array_sort(F.array_distinct("fields")), lambda x: F.struct(x.alias("f"), F.size(F.filter("fields", lambda y: y == x)).alias("n")))
        keyed = bad.select("result_id", F.struct("path", counted.alias("c")).alias("fp")).distinct()
        g = keyed.groupBy("fp").agg(F.min("result_id").alias("first_id"), F.count(F.lit(1)).alias("weight"))
        good = good.unionByName(salted_join(keyed, g, "fp", "weight", heavy).select("first_id", "result_id"))
    sizes = good.groupBy("first_id").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return salted_join(good, sizes, "first_id", "copies", heavy).select("first_id", "result_id", "copies")


def found(results: DataFrame) -> DataFrame:
    """(result_id, copy_id): each copy under its group's smallest result_id."""
    return copy_groups(results).filter("result_id > first_id").select(F.col("first_id").alias("result_id"), F.col("result_id").alias("copy_id"))


def collapsed(results: DataFrame) -> DataFrame:
    """(result_id, endpoint, copies): one record per endpoint, with the number of its copies.

    Records with null or blank endpoints stay, one each.
    """
    g = copy_groups(results).select("result_id", "first_id", "copies")
    r = results.select("result_id", F.col("request.endpoint").alias("endpoint")).filter("result_id is not null").groupBy("result_id").agg(F.min("endpoint").alias("endpoint"))
    j = r.join(g, "result_id", "left")
    return j.filter("first_id is null or first_id = result_id").select("result_id", "endpoint", F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"))
