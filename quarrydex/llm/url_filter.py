"""URL filter: host rules, then association rules mined by FP-growth.

Fixed rules name a host (with all its subdomains) and a leading part of the path; the
longest that fits decides. Other URLs are judged by mined rules. Labelled URLs become
sets of tokens (the host's names, path segments, query names), from which rules of at
most MAX_WORDS tokens that imply the bad label are mined:

1. A token that fewer than ``min_pages`` bad URLs have is in no rule. Of tokens that the
   very same URLs have, the first by name stands for all (equal counts and hash sums).
2. Spark's FP-growth finds the token sets of bad URLs. FP-growth can't bound the size of
   sets, and a set of t tokens has 2^t subsets; so a URL of many tokens is dealt to it in
   unions of MAX_WORDS blocks of BLOCK tokens. Any MAX_WORDS tokens are in one of them,
   and no basket has more than MAX_WORDS * BLOCK tokens.
3. Support and confidence of each candidate set are counted exactly over all labelled
   URLs, by the inverted index below. Sets stay by support, confidence, and lift over
   the share of bad URLs; a rule goes if a part of its tokens is as confident a rule.

A rule is posted in an inverted index under its rarest token; a URL looks up its tokens
there and keeps the candidates of which it has all tokens. The most confident one
blocks; no rule: allow. Rules are mined once and written; so is what they hit.

DataFrame and SQL functions and Spark ML alone. FP-growth gathers the tokens of
``min_pages`` bad URLs on the driver. Rules are broadcast only if they are at most
MAX_BROADCAST_RULES, else joined by a shuffle.

Nulls and oddities: a null URL or one without ``://`` has an empty host and path and
no token; only the default applies. Judgement is per distinct URL, so repeated rows
and null ids are judged alike and a URL of many pages is matched once. Without
labels no rule is mined. Empty tables give empty results. Other columns of pages are
not read, so their names don't matter.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrydex.llm.scratch import Scratch

#: (verdict, host, leading path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Least share, and least number, of labelled URLs that have a rule's tokens and the bad label. The number alone decides by default, so a bad host counts the same in a table of any size.
MIN_SUPPORT = 0.0
MIN_PAGES = 10
#: Least share of bad URLs among those with a rule's tokens, and least ratio of it to the share among all labelled URLs.
MIN_CONFIDENCE = 0.6
MIN_LIFT = 1.25
#: Most tokens of a rule, and tokens in a block.
MAX_WORDS = 3
BLOCK = 3
#: Baskets for each partition of FP-growth; each holds the sets of its own share of the tokens.
PARTITION_PAGES = 10_000
MAX_BROADCAST_RULES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of URLs; both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def fixed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, else null."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>") if not ordered else None
    for verdict, name, lead in ordered:
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(lead)
        value = F.struct(F.lit(name + lead).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL."""
    host, path = host_and_path(url)
    names = F.filter(F.split(host, r"\."), lambda x: x != "")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    tagged = [
        F.array(F.concat(F.lit("scheme="), F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1)))),
        F.transform(names, lambda x: F.concat(F.lit("name="), x)),
        F.transform(F.filter(F.split(path, "/"), lambda x: (x != "") & ~x.rlike("^[0-9]+([.][a-z]+)?$")), lambda x: F.concat(F.lit("path="), F.lower(x))),
        F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query="), F.element_at(F.split(x, "="), 1))),
    ]
    return F.when(F.instr(url, "://") > 0, F.array_distinct(F.concat(*tagged))).otherwise(F.array().cast("array<string>"))


def baskets(words: DataFrame) -> DataFrame:
    """(items): the token sets of (words) as FP-growth takes them, at most MAX_WORDS * BLOCK tokens each; any MAX_WORDS tokens of a set are in one of its baskets."""
    n = F.ceil(F.size("words") / F.lit(float(BLOCK))).cast("int")
    whole = words.where(n <= MAX_WORDS).select(F.col("words").alias("items"))
    rows = words.where(n > MAX_WORDS).select("words", n.alias("n"), F.array().cast("array<string>").alias("items"), F.lit(-1).alias("last"))
    for k in range(MAX_WORDS):  # a further block after the last one taken
        rows = rows.select("words", "n", "items", F.explode(F.sequence(F.col("last") + 1, F.col("n") - (MAX_WORDS - k))).alias("last"))
        rows = rows.withColumn("items", F.concat("items", F.slice("words", F.col("last") * BLOCK + 1, F.lit(BLOCK))))
    return whole.unionByName(rows.select("items"))


def posted(rules: DataFrame, frequency: DataFrame) -> DataFrame:
    """(words, ..., key): each rule with the rarest of its words, by (w, n)."""
    keys = rules.select("words", F.explode("words").alias("w")).join(frequency, "w").groupBy("words").agg(F.min_by("w", F.struct("n", "w")).alias("key"))
    return rules.join(keys, "words")


def hits(urls: DataFrame, index: DataFrame, n_rules: int) -> DataFrame:
    """Rows of urls, which have ``tokens``, beside each posted rule of which they have all words."""
    looked = urls.select("*", F.explode("tokens").alias("key"))
    return looked.join(F.broadcast(index) if n_rules <= MAX_BROADCAST_RULES else index, "key").where(F.size(F.array_except("words", "tokens")) == 0)


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_pages: int = MIN_PAGES, min_lift: float = MIN_LIFT) -> DataFrame:
    """(words, confidence, support): token sets that imply the bad label, from (url, bad); a written table."""
    spark = labelled.sparkSession
    scratch = Scratch(spark, "url-rules")
    known = labelled.where("url is not null and bad is not null").groupBy("url").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"))
    known = scratch.write(known.withColumn("tokens", tokens(F.col("url"))), "labelled")
    n, n_bad = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_bad"), F.lit(0))).first()
    least = max(min_pages, min_support * n)
    sums = known.select("url", "n", "n_bad", F.explode("tokens").alias("w")).groupBy("w")
    sums = sums.agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad"), F.sum(F.xxhash64("url").cast("decimal(38,0)")).alias("of")).where(F.col("n_bad") >= least)
    words = scratch.write(sums.groupBy("n", "of").agg(F.min("w").alias("w")).select("w", "n"), "words")
    bad = scratch.write(known.where("n_bad > 0").select(F.monotonically_increasing_id().alias("row"), "n_bad", "tokens"), "bad")
    own = bad.select("row", "n_bad", F.explode("tokens").alias("w")).join(words, "w", "left_semi").groupBy("row", "n_bad").agg(F.array_sort(F.collect_list("w")).alias("words"))
    # a URL of many pages is as many baskets
    sets = scratch.write(baskets(own.select("words", F.explode(F.sequence(F.lit(1), "n_bad"))).select("words")), "baskets")
    size = sets.count()
    rules = spark.createDataFrame([], "words array<string>, confidence double, support double")
    if size:
        parts = max(spark.sparkContext.defaultParallelism, -(-size // PARTITION_PAGES))
        # the half keeps rounding from asking for a page more
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / size), numPartitions=parts).fit(sets)
        found = model.freqItemsets.where(F.size("items") <= MAX_WORDS).select(F.array_sort("items").alias("words"))
        index = scratch.write(posted(found, words), "candidates")
        counted = hits(known, index, index.count()).groupBy("words").agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad"))
        rules = counted.select("words", (F.col("n_bad") / F.col("n")).alias("confidence"), (F.col("n_bad") / F.lit(n)).alias("support"))
        rules = rules.where((F.col("n_bad") >= least) & (F.col("confidence") >= min_confidence) & (F.col("confidence") * n >= min_lift * n_bad))
    rules = scratch.write(rules, "rules")
    parts_of = F.array_union(F.transform("words", lambda w: F.array(w)), F.transform("words", lambda w: F.array_except("words", F.array(w))))
    smaller = rules.select("words", "confidence", F.explode(F.filter(parts_of, lambda x: (F.size(x) > 0) & (F.size(x) < F.size("words")))).alias("part"))
    as_good = rules.select(F.col("words").alias("part"), F.col("confidence").alias("part_confidence"))
    needless = smaller.join(as_good, "part").where("part_confidence >= confidence").select("words").distinct()
    return scratch.write(rules.join(needless, "words", "left_anti").select("words", "confidence", "support"), "minimal")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, blocked_by): the most confident mined rule of each distinct URL that has one; a written table."""
    rules = rules.select(F.array_sort("words").alias("words"), "confidence", "support")
    frequency = rules.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    own = urls.where("url is not null").select("url").distinct().withColumn("tokens", tokens(F.col("url")))
    best = F.max(F.struct("confidence", "support", (-F.size("words")).alias("shorter"), F.array_join("words", " ").alias("name")))
    found = hits(own, posted(rules, frequency), rules.count()).groupBy("url").agg(best.alias("b")).select("url", F.col("b.name").alias("blocked_by"))
    # written, so that the join with the pages can be split where one URL has many
    return Scratch(urls.sparkSession, "url-hits").write(found, "hits")


def held_out_quality(labelled: DataFrame, **options) -> DataFrame:
    """(pages, bad, blocked, blocked_bad): what rules mined from four fifths of the URLs do on the others, chosen by a hash of the URL."""
    fold = F.pmod(F.xxhash64("url"), F.lit(5))
    rest = labelled.where("url is not null and bad is not null").where(fold == 0)
    hit = matched(rest, mine(labelled.where(fold != 0), **options)).select(F.col("url").alias("hit_url"), "blocked_by")
    judged = rest.join(hit, F.col("url") == F.col("hit_url"), "left")
    blocked = F.col("blocked_by").isNotNull()
    return judged.agg(F.count("*").alias("pages"), F.count_if("bad").alias("bad"), F.count_if(blocked).alias("blocked"), F.count_if(blocked & F.col("bad")).alias("blocked_bad"))


def filtered(pages: DataFrame, labelled: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(page_id, host, path, rule, verdict, blocked_by) for each page."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    hit = matched(rows, mine(labelled, min_support, min_confidence)).select(F.col("url").alias("hit_url"), "blocked_by")
    host, path = host_and_path(F.col("url"))
    joined = rows.join(hit, F.col("url") == F.col("hit_url"), "left").select("page_id", host.alias("host"), path.alias("path"), "blocked_by")
    fixed = fixed_rule(F.col("host"), F.col("path"), rules)
    out = joined.withColumn("fixed", fixed)
    mined = F.when(F.col("blocked_by").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), F.coalesce("fixed.verdict", mined).alias("verdict"), "blocked_by")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad): pages whose URL ends in the number of a labelled document; bad if any label of it says low quality or toxic."""
    number = F.regexp_extract(F.col("url"), r"/([0-9]{1,18})(?:[./?#][^/]*)?$", 1)
    rows = pages.select("url").where(number != "").withColumn("of", number.cast("long"))
    bad = labels.groupBy("doc_id").agg(F.max((F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).alias("bad"))
    return rows.join(bad, F.col("of") == F.col("doc_id")).select("url", "bad")
