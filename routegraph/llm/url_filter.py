"""URL filter: host and path rules, and for the URLs that no rule decides gradient-boosted trees on lexical features.

The trees are trained on labelled URLs: those that a rule has decided, all of them. Features are length, depth, digit
ratio, entropy, parameter counts, hyphens and labels of the host, and statistics of the host's suffix: how common it
is and how often labelled URLs under it are blocked, and likewise under the path's first segment and under both. Rates are taken out of fold: a labelled URL sees only the labels of
other folds, so the trees do not learn from their own answers. ``held_out_accuracy`` judges labelled URLs by trees of other folds.

Defined results: a null URL, or one without ``://``, has an empty host and path and is judged by the model on empty
features; with no labelled URL, or labels of one kind only, the model's verdict is that kind, or allow; repeated rows are
judged alike; an empty table gives an empty result. Only page_id and url are read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import land, salted_join

#: (verdict, host, path prefix), as the contract gives them.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Folds of labelled URLs, by a hash of the URL; copies of a URL share a fold.
FOLDS = 5
#: Statistics of suffixes are broadcast up to this many; beyond it they are joined by a shuffle.
BROADCAST_SUFFIXES = 500_000
FEATURES = ("url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "entropy", "n_parameters", "n_hyphens", "n_encoded", "has_fragment", "suffix_share", "suffix_block_rate", "lead_block_rate", "suffix_lead_block_rate")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    begin = F.instr(url, "://")
    rest = F.when(begin > 0, F.substr(url, begin + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def ruled(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as ``host`` + ``path``, and its verdict; nulls where none fits. A rule fits its host and all its subdomains."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, at, prefix in reversed(ordered):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(prefix)
        name, verdict = F.when(fits, F.lit(at + prefix)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def lexical_features(pages: DataFrame) -> DataFrame:
    """``pages`` (url, host, path) with all features but those of the suffix."""
    url = F.coalesce("url", F.lit(""))
    letters = F.split(url, "")
    n = F.greatest(F.length(url), F.lit(1))
    # entropy over the distinct characters: their counts come from the length that the URL loses without each
    share = lambda c: (F.length(url) - F.length(F.replace(url, c))) / n
    entropy = F.aggregate(F.filter(F.array_distinct(letters), lambda c: c != ""), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    query = F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(""))
    return pages.withColumns(
        {
            "url_length": F.length(url),
            "host_length": F.length("host"),
            "path_length": F.length("path"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")),
            "host_labels": F.size(F.split("host", r"\.")),
            "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / n,
            "entropy": entropy,
            "n_parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
            "n_hyphens": F.length(url) - F.length(F.replace(url, F.lit("-"))),
            "n_encoded": F.length(url) - F.length(F.replace(url, F.lit("%"))),
            "has_fragment": F.instr(url, "#").cast("boolean").cast("int"),
            "suffix": F.element_at(F.split("host", r"\."), -1),
            "lead": F.regexp_extract("path", "^/([^/]*)", 1),
        }
    ).withColumn("suffix_lead", F.concat_ws("/", "suffix", "lead"))


def with_block_rates(pages: DataFrame, counted: DataFrame, key: str, total: int, labelled: int, blocked: int) -> DataFrame:
    """``pages`` with ``{key}_share``, the share of all URLs that have its value of ``key``, and ``{key}_block_rate``, the smoothed share of blocked among the
    labelled ones of these that are in another fold (all labelled ones, for a URL without a label). ``counted`` is a landed table of the same rows. Up to
    BROADCAST_SUFFIXES values are broadcast; where there are more, values of many rows are salted."""
    folds = counted.groupBy(key, "fold").agg(F.count("*").alias("n"), F.count("verdict").alias("labelled"), F.count_if(F.col("verdict") == "block").alias("blocked"))
    per = lambda c: F.transform(F.sequence(F.lit(0), F.lit(FOLDS - 1)), lambda f: F.aggregate(F.filter("folds", lambda x: x["fold"] == f), F.lit(0).cast("long"), lambda a, x: a + x[c]))
    by = folds.groupBy(key).agg(F.collect_list(F.struct("fold", "labelled", "blocked")).alias("folds"), F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    by = land(by.select(key, "n", "labelled", "blocked", per("labelled").alias("fold_labelled"), per("blocked").alias("fold_blocked")), "rates")
    rate = (blocked + 0.5) / (labelled + 1.0)
    stats = by.select(key, F.col("n").alias("_n"), *[F.col(c).alias(f"_{c}") for c in ("labelled", "blocked", "fold_labelled", "fold_blocked")])
    joined = pages.join(F.broadcast(stats), key) if by.count() <= BROADCAST_SUFFIXES else salted_join(pages, stats, key, "page_id", counted)
    of = lambda c: F.col(f"_{c}") - F.when(F.col("verdict").isNotNull(), F.element_at(f"_fold_{c}", F.col("fold") + 1)).otherwise(0)
    shares = {f"{key}_share": F.col("_n") / max(total, 1), f"{key}_block_rate": (of("blocked") + 20 * rate) / (of("labelled") + 20.0)}
    return joined.withColumns(shares).drop("_n", "_labelled", "_blocked", "_fold_labelled", "_fold_blocked")


def with_suffix_statistics(pages: DataFrame) -> DataFrame:
    """Landed ``pages`` with the share of the host's suffix, and rates of it, of the path's first segment and of both together."""
    counted = pages
    total, labelled, blocked = counted.agg(F.count("*"), F.count("verdict"), F.count_if(F.col("verdict") == "block")).first()
    for key in ("suffix", "lead", "suffix_lead"):
        pages = with_block_rates(pages, counted, key, total, labelled, blocked)
    return pages.drop("lead_share", "suffix_lead_share")


def featured(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """A landed table of page_id, host, path, rule, the rule's verdict, fold and FEATURES."""
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    name, verdict = ruled(F.col("host"), F.col("path"), rules)
    fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")
    rows = with_suffix_statistics(land(lexical_features(split.withColumns({"rule": name, "verdict": verdict, "fold": fold})), "url-features"))
    return land(rows.select("page_id", "host", "path", "rule", "verdict", "fold", *[F.col(f).cast("double").alias(f) for f in FEATURES]), "url-table")


def fitted(table: DataFrame, trees: int, depth: int) -> tuple[VectorAssembler, GBTClassificationModel]:
    """Trees over the rows of ``table`` that have a verdict."""
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    train = assembled.transform(table.where("verdict is not null")).select("features", (F.col("verdict") == "block").cast("double").alias("label"))
    return assembled, GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=3, checkpointInterval=-1, cacheNodeIds=False).fit(train)


def judge(pages: DataFrame, rules: tuple = RULES, trees: int = 20, depth: int = 4) -> DataFrame:
    """page_id, host, path, rule, verdict, and the model's block_score where no rule decides."""
    table = featured(pages, rules)
    kinds = {r["verdict"] for r in table.where("verdict is not null").select("verdict").distinct().collect()}
    if len(kinds) < 2:
        only = next(iter(kinds), "allow")
        return table.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    assembled, model = fitted(table, trees, depth)
    score = vector_to_array("probability")[1]
    return model.transform(assembled.transform(table)).select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict", F.when(F.col("prediction") > 0.5, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("verdict").isNull(), score).alias("block_score"),
    )


def held_out_accuracy(pages: DataFrame, rules: tuple = RULES, trees: int = 20, depth: int = 4, fold: int = 0) -> tuple[float, float]:
    """Of the labelled URLs of one fold, the share that trees of the other folds judge as their rule does, and the share of the more
    frequent verdict."""
    table = featured(pages, rules).where("verdict is not null")
    assembled, model = fitted(table.where(F.col("fold") != fold), trees, depth)
    told = model.transform(assembled.transform(table.where(F.col("fold") == fold)))
    block = (F.col("verdict") == "block").cast("double")
    right, blocked = told.agg(F.avg((F.col("prediction") == block).cast("double")), F.avg(block)).first()
    return right, max(blocked, 1 - blocked)
