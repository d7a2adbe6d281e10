"""Secret scans by corpus-wide ownership.

Patterns find candidates with their places; the hash of each secret is then counted over the repositories and owners that
hold it. A secret that many owners copy is an example, one that a single owner holds looks live. Only DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclake.llm.common import free_name, shuffle_partitions, stored

# The base patterns. Letters of the first one's names stand in either case.
ASSIGN = (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
# A run of hexadecimal digits is matched whole, so runs that are too short need not be listed first.
HEX = r"[0-9a-f]{24,}"
# Candidates that count only if a single owner has them: long runs of letters, digits, _ and - with a letter and a digit.
LONG = r"[A-Za-z0-9_-]{20,}"

# What an owned run must not be to be replaced: a UUID.
UUID = r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"
# Its parts between _ and - that read like words, numbers or words with a number before or after them.
PLAIN_PART = (r"[A-Z]?[a-z]*[0-9]*|[A-Z]+[0-9]*|[0-9]+([A-Z]?[a-z]*|[A-Z]+)[0-9]*[A-Z]?|[A-Za-z]?[a-z]*[0-9]{0,4}([A-Z][a-z]+[0-9]{0,4})+"
              r"|[a-z]{4,}[0-9]{1,4}[a-z]{4,}[0-9]*")
#: Bits of a run's characters, by their frequency in it, for each bit that as many different characters would have.
LEAST_ENTROPY = 0.6

KINDS = ("assign", "access", "hex", "owned")
#: A secret of so many owners or more is a widely copied example.
EXAMPLE_OWNERS = 3


def hits(text: Column, kind: int, pattern: str, value, sound) -> Column:
    """Array of (kind, pos, gap, len, value, sound) of all leftmost non-overlapping matches; lengths in code points.

    The texts between matches and the matches themselves come from the same matcher, so their lengths sum to places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    all_ = F.transform(F.arrays_zip(gaps.alias("gap"), found.alias("hit")), lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("pos"), F.char_length(x["gap"]).cast("long").alias("gap"), F.char_length(x["hit"]).cast("long").alias("len"),
        value(x["hit"]).alias("value"), sound(x["hit"]).alias("sound")))
    # most texts have none: one look tells, and spares the two passes
    return F.when(F.rlike(text, F.lit(pattern)), all_).otherwise(F.slice(F.array(F.struct(
        F.lit(kind).alias("kind"), F.lit(0).alias("pos"), F.lit(0).cast("long").alias("gap"), F.lit(0).cast("long").alias("len"), F.lit("").alias("value"), F.lit(True).alias("sound"))), F.lit(1), F.lit(0)))


def candidates(docs: DataFrame, id: str, text: str, repository: Column, owner: Column) -> DataFrame:
    """One row for every candidate, and one with kind -1 for every different row of (id, text, repository, owner).

    Columns: id, digest, repository, owner (these four name a row), copies (how often it occurs), kind (place in
    ``KINDS``), start, end, secret (hash of the value).
    """
    body = F.coalesce(F.col(text), F.lit(""))
    whole, group = lambda h: h, lambda h: F.regexp_extract(h, ASSIGN, 2)
    length = F.char_length
    everything = F.concat(
        F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("pos"), F.lit(0).cast("long").alias("gap"), F.lit(0).cast("long").alias("len"), F.lit("").alias("value"), F.lit(True).alias("sound"))),
        hits(body, 0, ASSIGN, group, lambda h: length(group(h)) >= 6), hits(body, 1, ACCESS, whole, lambda h: length(h) >= 20),
        hits(body, 2, HEX, whole, lambda h: length(h) >= 24), hits(body, 3, LONG, whole, lambda h: h.rlike("[0-9]") & h.rlike("[A-Za-z]")))
    row = ["id", "digest", "repository", "owner"]
    rows = docs.select(F.col(id).alias("id"), F.sha2(body, 256).alias("digest"), repository.alias("repository"), owner.alias("owner"), F.explode(everything).alias("c")).select(*row, "c.*")
    # rows of a document meet once; repeated rows become a count
    met = rows.repartition(shuffle_partitions(docs.sparkSession), "id", "digest")
    once = met.groupBy(*row, "kind", "pos").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("gap", "len", "value", "sound")])
    before = Window.partitionBy(*row, "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = once.withColumn("start", F.coalesce(F.sum(F.col("gap") + F.col("len")).over(before), F.lit(0)) + F.col("gap"))
    placed = placed.where("sound").withColumn("end", F.col("start") + F.col("len"))
    # a long run that meets a base match is that match's business
    base = F.col("kind").between(0, 2)
    at = Window.partitionBy(*row).orderBy("start")
    left = F.max(F.when(base, F.col("end"))).over(at.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    right = F.min(F.when(base, F.col("start"))).over(at.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    placed = placed.withColumn("left", left).withColumn("right", right).where(
        "kind != 3 or (coalesce(left <= start, true) and coalesce(right >= end, true))")
    return placed.select(*row, "copies", "kind", "start", "end", F.sha2("value", 256).alias("secret"))


def ownership(found: DataFrame) -> DataFrame:
    """(secret, n_owners, n_repositories): different owners and, within owners, repositories that hold a secret.

    Null owners or repositories count as one. Both steps combine before they shuffle, so a secret in a third of all
    rows arrives as one row for each of its owners and tasks.
    """
    pairs = found.where("kind >= 0").select("secret", "owner", "repository").distinct()
    return pairs.groupBy("secret", "owner").agg(F.count("*").alias("n")).groupBy("secret").agg(
        F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def judged(found: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Candidates that stay, with n_owners, n_repositories and standing (`example`, `shared` or `live`).

    Base kinds always stay; `owned` ones only if a single owner has them. Rows of kind -1 pass through.
    """
    # rows of kind -1 are as many as documents and have no secret: they stay out of the join
    known = found.where("kind >= 0").join(ownership(found), "secret", "left").unionByName(found.where("kind < 0"), allowMissingColumns=True)
    standing = F.when(F.col("n_owners") >= example_owners, "example").when(F.col("n_owners") == 1, "live").otherwise("shared")
    return known.withColumn("standing", F.when(F.col("kind") >= 0, standing)).where("kind != 3 or standing = 'live'")


def scan_secrets(docs: DataFrame, id: str, text: str, repository: Column, owner: Column, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """(id, digest, repository, owner, found, copies): one row for every different row of these, ``found`` its candidates.

    ``found`` is an array of (start, kind, end, standing, n_owners, n_repositories) by start and kind; ``kind`` is a place
    in ``KINDS``, places are code points. Null texts are empty; empty tables give no rows; other columns are not read.
    ``copies`` says how often the row occurs.
    """
    found = stored(candidates(docs, id, text, repository, owner), "secret-candidates")
    kept = judged(found, example_owners)
    span = F.when(F.col("kind") >= 0, F.struct("start", "kind", "end", "standing", "n_owners", "n_repositories"))
    return kept.groupBy("id", "digest", "repository", "owner").agg(
        F.array_sort(F.collect_list(span)).alias("found"), F.max(F.when(F.col("kind") == -1, F.col("copies"))).alias("copies"))


def span_text(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(
        ":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def credential_like(run: Column) -> Column:
    """Whether a run of letters, digits, _ and - looks made by a machine to be secret.

    UUIDs do not, nor do slugs, identifiers and names: the parts between _ and - that are no words or numbers must together
    have 16 characters, of two classes at least (capitals, small letters, digits), and entropy near that of so many
    different characters.
    """
    odd = F.array_join(F.filter(F.split(run, "[_-]+"), lambda part: ~part.rlike(f"^({PLAIN_PART})$")), "")
    length = F.char_length(odd).cast("double")
    letters = F.filter(F.split(odd, ""), lambda c: c != "")
    bits = F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda sum_, c: sum_ - (F.size(F.filter(letters, lambda x: x == c)) / length) * F.log2(F.size(F.filter(letters, lambda x: x == c)) / length))
    classes = sum((odd.rlike(p).cast("int") for p in ("[A-Z]", "[a-z]", "[0-9]")), F.lit(0))
    return ~run.rlike(f"^{UUID}$") & (length >= 16) & (classes >= 2) & (bits >= LEAST_ENTROPY * F.log2(F.least(length, F.lit(36.0))))


def redact(docs: DataFrame, id: str, text: str, repository: Column, owner: Column, mark: str = "[secret]", example_owners: int = EXAMPLE_OWNERS,
           owned: Callable[[Column], Column] | None = None) -> DataFrame:
    """``docs`` with every span that is not a widely copied example replaced by ``mark``; overlapping spans become one mark.

    With ``owned`` spans of that kind are replaced only if it holds for their text. Rows without such spans keep their text, null texts stay null; all rows
    and columns stay, whatever their names; an empty table gives no rows.
    """
    name = {n: free_name(docs, f"_{n}") for n in ("id", "digest", "repository", "owner", "found", "cut")}
    spans = scan_secrets(docs, id, text, repository, owner, example_owners).select(
        *[F.col(n).alias(name[n]) for n in ("id", "digest", "repository", "owner")], F.filter("found", lambda x: x["standing"] != "example").alias(name["found"])).where(F.size(name["found"]) > 0)
    body = F.coalesce(F.col(text), F.lit(""))
    met = docs.join(spans, F.col(id).eqNullSafe(F.col(name["id"])) & (F.sha2(body, 256) == F.col(name["digest"])) & repository.eqNullSafe(F.col(name["repository"]))
                    & owner.eqNullSafe(F.col(name["owner"])), "left")
    if owned is not None:
        met = met.withColumn(name["found"], F.filter(name["found"], lambda x: (x["kind"] != 3) | owned(F.substring(F.col(text), x["start"].cast("int") + 1, (x["end"] - x["start"]).cast("int")))))
    # spans sorted by start merge in one pass over the array of marks' starts and ends
    ends = F.transform(name["found"], lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    merged = F.aggregate(ends, F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"), lambda done, x: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["start"]),
        F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end")))))
        .otherwise(F.concat(done, F.array(x))))
    met = met.withColumn(name["cut"], F.when(F.size(name["found"]) > 0, merged))
    pieces = F.transform(name["cut"], lambda x, i: F.concat(F.substring(F.col(text), F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(name["cut"], i - 1)["end"]).cast("int") + 1,
                                                           (x["start"] - F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(name["cut"], i - 1)["end"])).cast("int")), F.lit(mark)))
    last = F.substring(F.col(text), F.element_at(name["cut"], -1)["end"].cast("int") + 1, F.char_length(text))
    cleaned = F.when(F.col(name["cut"]).isNull(), F.col(text)).otherwise(F.concat(F.array_join(pieces, ""), last))
    return met.withColumn(text, cleaned).select(*docs.columns)
