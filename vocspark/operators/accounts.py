"""Account-table hygiene: e-mail checks with typo suggestions, one row per
address, directory listing and look-up.  The fixed list of 11 known domains is
matched by an array expression per row; a list of any length by an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocspark import lexicon as lx
from vocspark.functions import labels as lb
from vocspark.functions import text as tx


def normalize_email(email) -> Column:
    return F.lower(tx.ws_trim(email))


def email_domain(email) -> Column:
    return F.substring_index(normalize_email(email), "@", -1)


def _swap_once(a: Column, b: Column) -> Column:
    """a equals b with exactly one pair of adjacent characters swapped."""
    n = F.length(b)
    swapped = F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (
        (F.substring(b, i, 1) != F.substring(b, i + 1, 1))
        & (a == F.concat(F.substring(b, 1, i - 1), F.substring(b, i + 1, 1),
                         F.substring(b, i, 1), F.substring(b, i + 2, 1 << 20)))))
    return (F.length(a) == n) & (n >= 2) & swapped


def one_edit_apart(a: Column, b: Column) -> Column:
    """Optimal-string-alignment distance == 1 (insert, delete, substitute or
    swap two adjacent characters)."""
    return (F.levenshtein(a, b) == 1) | _swap_once(a, b)


def typo_suggestion(domain: Column) -> Column:
    """First known domain one edit away, unless the domain is known or a
    genuine look-alike provider."""
    known = tx.str_array(lx.COMMON_DOMAINS)
    exempt = tx.str_array(lx.COMMON_DOMAINS + lx.REAL_LOOKALIKE_DOMAINS)
    first = F.get(F.filter(known, lambda k: one_edit_apart(domain, k)), 0)
    return F.when(~F.array_contains(exempt, domain), first)


def check_emails(df: DataFrame, email: str = "email") -> DataFrame:
    """Adds email_norm, valid_format, domain, suggestion and reason."""
    d = df.withColumn("email_norm", normalize_email(email))
    d = d.withColumns({"valid_format": F.col("email_norm").rlike(lx.EMAIL_PATTERN),
                       "domain": F.substring_index(F.col("email_norm"), "@", -1)})
    d = d.withColumn("suggestion", F.when(F.col("valid_format"), typo_suggestion(F.col("domain"))))
    reason = (F.when(~F.col("valid_format"), "invalid format")
              .when(F.col("suggestion").isNotNull(), "domain typo"))
    return d.withColumn("reason", reason)


def deletions(word: Column) -> Column:
    """The word and every form of it with one character deleted: two words one
    edit (or swap) apart share one of these."""
    n = F.length(word)
    return F.array_distinct(F.concat(F.array(word), F.when(n > 0, F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.concat(F.substring(word, 1, i - 1), F.substring(word, i + 1, 1 << 20)))).otherwise(F.array())))


def domain_suggestions(domains: DataFrame, known: DataFrame, exempt=lx.REAL_LOOKALIKE_DOMAINS) -> DataFrame:
    """(domain, suggestion) of the distinct `domains.domain` that are one edit
    away from a domain in `known` (domain, rank) and neither known nor exempt;
    the known domain of the lowest rank, ties by name.  An equi-join on shared
    deletion forms proposes, the edit distance decides; a list of any length
    is one shuffle.  Null domains have no suggestion."""
    unknown = domains.select("domain").where(F.col("domain").isNotNull() & ~F.col("domain").isin(*exempt)) \
        .distinct().join(known.select("domain"), "domain", "left_anti")
    mine = unknown.select("domain", F.explode(deletions(F.col("domain"))).alias("form"))
    theirs = known.where("domain IS NOT NULL").select(
        F.col("domain").alias("known"), "rank", F.explode(deletions(F.col("domain"))).alias("form"))
    pairs = mine.join(theirs, "form").select("domain", "known", "rank").distinct() \
        .where(one_edit_apart(F.col("domain"), F.col("known")))
    return pairs.groupBy("domain").agg(F.min(F.struct("rank", "known")).alias("best")) \
        .select("domain", F.col("best.known").alias("suggestion"))


def known_domains(spark: SparkSession) -> DataFrame:
    rows = list(enumerate(lx.COMMON_DOMAINS))
    return spark.createDataFrame([(d, i) for i, d in rows], "domain string, rank int")


def check_emails_against(df: DataFrame, known: DataFrame, email: str = "email") -> DataFrame:
    """`check_emails` with known domains (domain, rank) from a table."""
    d = df.withColumn("email_norm", normalize_email(email))
    d = d.withColumn("valid_format", F.col("email_norm").rlike(lx.EMAIL_PATTERN)) \
        .withColumn("domain", F.substring_index(F.col("email_norm"), "@", -1))
    found = domain_suggestions(d.where("valid_format").select("domain"), known)
    d = d.join(found, "domain", "left").withColumn("suggestion", F.when(F.col("valid_format"), F.col("suggestion")))
    reason = (F.when(~F.col("valid_format"), "invalid format")
              .when(F.col("suggestion").isNotNull(), "domain typo"))
    return d.withColumn("reason", reason)


def unique_accounts(df: DataFrame, email: str = "email", ts: str = "created_at",
                    id_col: str = "id") -> DataFrame:
    """One row per normalised e-mail: the earliest (created_at, id); later
    duplicates are rejected.  A min over a struct aggregates map-side, so a
    very common address does not pile its rows into one task.  Rows without an
    address are no duplicates of each other: all stay."""
    others = [c for c in df.columns if c not in (ts, id_col)]
    row = F.struct(ts, id_col, *others)
    g = df.where(F.col(email).isNotNull()).groupBy(normalize_email(email)).agg(F.min(row).alias("r"))
    return g.unionByName(df.where(F.col(email).isNull()).select(
        F.lit(None).cast("string").alias(g.columns[0]), row.alias("r"))).select("r.*")


#: Partitions of a stored account table; one of them holds an address.
LOOKUP_BUCKETS = 64


def _bucket(address: Column) -> Column:
    return F.pmod(F.xxhash64(address), F.lit(LOOKUP_BUCKETS)).cast("int")


def write_accounts(df: DataFrame, path: str, email: str = "email") -> None:
    """Stores accounts for look-ups: the address normalised once, rows dealt by
    its hash to partitions and sorted by it in files with a Bloom filter.  Rows
    without an address are stored too (and found by none)."""
    d = df.withColumn("email_norm", normalize_email(email)).withColumn("bucket", _bucket(F.col("email_norm")))
    # rows without an address have one hash: their id deals them out
    d.repartition("bucket", F.when(F.col("email_norm").isNull(), F.rand(7))).sortWithinPartitions("bucket", "email_norm") \
        .write.mode("overwrite").option("parquet.bloom.filter.enabled#email_norm", "true") \
        .partitionBy("bucket").parquet(path)


def lookup_account(spark: SparkSession, path: str, email_query: str) -> DataFrame:
    """Accounts of one address from a table of `write_accounts`: one partition
    is read, and in it the row groups that may hold the address."""
    address = F.lit(email_query.strip().lower())
    return spark.read.parquet(path).where((F.col("bucket") == _bucket(address)) & (F.col("email_norm") == address))


def account_lookup(df: DataFrame, email_query: str, email: str = "email") -> DataFrame:
    return df.where(normalize_email(email) == F.lit(email_query.strip().lower()))


def account_directory(df: DataFrame) -> DataFrame:
    """Listing ordered by created_at: Yes/No verified flag, display name, initials."""
    return (df.select("id", "name", normalize_email("email").alias("email"), "provider", "role",
                      lb.flag_to_label("verified").alias("verified"), "created_at",
                      tx.display_name(normalize_email("email")).alias("display_name"),
                      tx.initials("name").alias("initials"))
            .orderBy("created_at", "id"))


def account_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("accounts"))


def conform_schema(df: DataFrame, defaults: dict) -> DataFrame:
    """Add each missing column with its default (idempotent migration)."""
    missing = {c: F.lit(v) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df
