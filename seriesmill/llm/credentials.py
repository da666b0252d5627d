"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Three kinds of candidates are found in every text.  Their values are hashed and counted over the
whole corpus by distinct repositories and owners.  A value that several owners or many
repositories hold is a copied example; one that belongs to a single owner and looks random is a
live credential.  Both add a span over the value itself.  The label of a single owner's value that
does not look random is also "example", as in the SQL of the query; such a value may well be a
secret (letters only), so masking goes by the owner alone and not by the label.

Positions: the gaps between matches (split by the pattern) and the matches alternate, so a running
sum over their lengths gives code-point offsets.  The sum is a window over one text's matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from seriesmill.llm.common import FILE, ROW, restored, set_aside, stored, with_row_keys
from seriesmill.session import bounded_broadcast

# Kinds in their order, patterns, least lengths (of the value).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "live", "example"]
ASSIGN_LEAST = 12
# One pass that finds every text with a candidate, and some without.
ANY = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{14}|[0-9a-f]{16}"

# A value that more owners or repositories hold is an example.
MAX_OWNERS, MAX_REPOSITORIES = 1, 3
# A live-looking value has so many different characters, and a digit.
LEAST_DISTINCT = 6
MASK = "[credential]"


def _pieces(kind: str, pattern: str) -> Column:
    gaps = F.transform(F.split("text", pattern, -1), lambda g: F.length(g))
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(F.slice(gaps, 1, F.greatest(F.size(found), F.lit(0))).alias("gap"), found.alias("match"))
    return F.struct(F.lit(kind).alias("kind"), zipped.alias("found"))


def candidates(keyed: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """One row per base span: FILE, ROW, kind, start, end, value, from (where the value begins; it
    ends with the span), hash, random, repository, owner."""
    rows = keyed.select(FILE, ROW, "text", repository.alias("repository"), owner.alias("owner")).where(F.col("text").rlike(ANY))
    kinds = F.explode(F.array(_pieces("assign", ASSIGN), _pieces("access", ACCESS), _pieces("hex", HEX)))
    by_kind = rows.select(FILE, ROW, "repository", "owner", kinds.alias("k")).select(
        FILE, ROW, "repository", "owner", F.col("k.kind").alias("kind"), F.posexplode("k.found").alias("place", "f"))
    running = Window.partitionBy(FILE, ROW, "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("f.match")
    end = F.sum(F.col("f.gap").cast("long") + size).over(running)
    value = F.when(F.col("kind") == "assign", F.regexp_extract("f.match", ASSIGN, 1)).otherwise(F.col("f.match"))
    spans = by_kind.select(
        FILE, ROW, "repository", "owner", "kind", (end - size).alias("start"), end.alias("end"), value.alias("value"))
    kept = spans.where((F.col("kind") != "assign") | (F.length("value") >= ASSIGN_LEAST))
    mixed = F.size(F.array_distinct(F.split("value", ""))) >= LEAST_DISTINCT
    return kept.select(
        "*", (F.col("end") - F.length("value")).alias("from"), F.sha2("value", 256).alias("hash"),
        (mixed & F.col("value").rlike("[0-9]")).alias("random"))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repositories, single, label) over the whole corpus.  Null owners count as one owner.

    Combinations are made distinct first: a value copied into a third of all rows is a handful of
    rows after the partial aggregate.
    """
    held = found.groupBy("hash", "repository", "owner").agg(F.bool_or("random").alias("random"))
    per_owner = held.groupBy("hash", "owner").agg(
        F.count(F.lit(1)).alias("repositories"), F.bool_or("random").alias("random"))
    counted = per_owner.groupBy("hash").agg(
        F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.bool_or("random").alias("random"))
    single = (F.col("owners") <= MAX_OWNERS) & (F.col("repositories") <= MAX_REPOSITORIES)
    return counted.select(
        "hash", "owners", "repositories", single.alias("single"), F.when(single & F.col("random"), "live").otherwise("example").alias("label"))


def owned(keyed: DataFrame, repository: Column, owner: Column) -> tuple[DataFrame, DataFrame]:
    """The candidates of the table with row keys, and the same with the ownership of their values."""
    found = stored(candidates(keyed, repository, owner), "credentials")
    return found, found.join(ownership(found).select("hash", "single", "label"), "hash")


def labelled(keyed: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """All spans of the table with row keys: the base spans and one span per labelled value."""
    found, values = owned(keyed, repository, owner)
    added = values.select(FILE, ROW, F.col("label").alias("kind"), F.col("from").alias("start"), "end", "value").distinct()
    return found.select(FILE, ROW, "kind", "start", "end", "value").unionByName(added)


def scan(docs: DataFrame, repository: Column, owner: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id and found, its spans array<struct<start, kind, end, value>> by
    start, then kind in the order of KINDS.

    A null text is empty.  Repeated rows are rows of their own.  Other columns are ignored; null
    repositories and owners are values like any other.  An empty table gives an empty result.
    """
    keyed = with_row_keys(docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
        repository.alias("repository"), owner.alias("owner")))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    per_row = labelled(keyed, F.col("repository"), F.col("owner")).groupBy(FILE, ROW).agg(
        F.sort_array(F.collect_list(F.struct("start", order.alias("order"), "kind", "end", "value"))).alias("found"))
    none = F.array().cast(per_row.schema["found"].dataType)
    return keyed.select("doc_id", FILE, ROW).join(per_row, [FILE, ROW], "left").select(
        "doc_id", F.coalesce("found", none).alias("found"))


def occurrences(text: Column, value: Column) -> Column:
    """Array of (start, end) of a value in a text, from 0, end exclusive."""
    gaps = F.split(text, F.concat(F.lit("\\Q"), value, F.lit("\\E")), -1)
    size = F.length(value)
    ends = F.aggregate(
        F.slice(gaps, 1, F.size(gaps) - 1), F.array().cast("array<int>"),
        lambda seen, gap: F.array_append(seen, F.coalesce(F.try_element_at(seen, F.lit(-1)), F.lit(0)) + F.length(gap) + size))
    return F.transform(ends, lambda end: F.struct((end - size).alias("start"), end.alias("end")))


def masked(text: Column, values: Column) -> Column:
    """The text with MASK for every stretch that occurrences of the values cover, alone or together."""
    spans = F.array_sort(F.flatten(F.transform(values, lambda v: occurrences(text, v))))
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("upto"))

    def step(a, s):
        apart = s["start"] >= a["upto"]
        gap = F.concat(a["done"], F.substring(text, a["upto"] + 1, s["start"] - a["upto"]), F.lit(MASK))
        return F.struct(F.when(apart, gap).otherwise(a["done"]).alias("done"), F.greatest(a["upto"], s["end"]).alias("upto"))

    return F.aggregate(spans, start, step, lambda a: F.concat(a["done"], F.substring(text, a["upto"] + 1, F.length(text))))


def mask_live(docs: DataFrame, repository: Column, owner: Column, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """`docs` with MASK for every stretch of a text that values of a single owner cover, whether they look
    random or not, and n_chars set anew; all rows and columns stay, texts without such a value are untouched.

    All occurrences of a value in its text count, also where no pattern finds it; overlapping values
    (one inside another, or across its end) are one stretch.
    """
    extended = docs.select("*", repository.alias("__repository"), owner.alias("__owner"))
    inner, (text, repository, owner) = set_aside(extended, text, "__repository", "__owner")
    keyed = with_row_keys(inner)
    plain = keyed.select(FILE, ROW, F.coalesce(F.col(text), F.lit("")).alias("text"), repository, owner)
    _, values = owned(plain, F.col(repository), F.col(owner))
    live = values.where("single").groupBy(FILE, ROW).agg(F.collect_set("value").alias("live"))
    changed = keyed.join(bounded_broadcast(stored(live, "live")), [FILE, ROW], "left")
    changed = changed.withColumn(text, F.when(F.col("live").isNull(), F.col(text)).otherwise(masked(F.col(text), F.col("live"))))
    if n_chars in docs.columns:
        size = f"__{docs.columns.index(n_chars)}"
        changed = changed.withColumn(size, F.when(F.col("live").isNull(), F.col(size)).otherwise(
            F.length(text).cast(docs.schema[n_chars].dataType)))
    return restored(changed, docs)
