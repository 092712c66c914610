"""URL filter: host and path rules first, else gradient-boosted trees on lexical features.  DataFrame functions only."""

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.plans.settle import settle

from .common import ascii_lower

#: Rules of the registered query: (verdict, host/path).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
         ("block", "net/fr/"))
#: Rows that the trees learn from at most.
TRAIN_ROWS = 20_000
FEATURES = ["url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "hyphens", "entropy", "params",
            "fragment", "suffix_rate", "suffix_log_n", "segment_rate"]


def host_path(url) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or where there is no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host, path, rules) -> Column:
    """The longest rule that fits, as struct (size, host size, rule, verdict), or null.  A host is looked up with all its
    parent domains in one map of the rules, so the work goes with the host's labels and not with the rules."""
    by_host = {}
    for verdict, rule in rules:
        name, slash, where = rule.partition("/")
        by_host.setdefault(name.lower(), []).append((slash + where, rule, verdict))
    kind = "array<struct<path:string,rule:string,verdict:string>>"
    listed = [[F.lit(h), F.array(*[F.struct(F.lit(p).alias("path"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"))
                                   for p, r, v in rs])] for h, rs in by_host.items()]
    table = F.create_map(*[x for pair in listed for x in pair]) if listed else F.create_map().cast(f"map<string,{kind}>")
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = F.flatten(F.transform(parents, lambda h: F.coalesce(F.try_element_at(table, h), F.array().cast(kind))))
    fit = F.filter(found, lambda r: F.startswith(path, r["path"]))
    ranked = F.transform(fit, lambda r: F.struct(F.length(r["rule"]).alias("size"), (-F.length(r["path"])).alias("host"),
                                                 r["rule"].alias("rule"), r["verdict"].alias("verdict")))
    return F.array_max(ranked)


def lexical(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, host, path, ...) with the lexical features that need no statistics."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.length(url).cast("double")
    digits = n - F.length(F.translate(url, "0123456789", ""))

    def bits(acc, c):
        share = (n - F.length(F.replace(url, c, F.lit("")))) / n
        return acc - share * F.log2(share)

    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    entropy = F.aggregate(F.array_distinct(F.filter(F.split(url, ""), lambda c: c != "")), F.lit(0.0), bits)
    return pages.withColumns({
        "url_length": n, "host_length": F.length("host").cast("double"), "path_length": F.length("path").cast("double"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")).cast("double"),
        "labels": F.size(F.split("host", r"\.")).cast("double"),
        "digit_ratio": F.when(n > 0, digits / n).otherwise(F.lit(0.0)),
        "hyphens": (F.length("host") - F.length(F.translate("host", "-", ""))).cast("double"),
        "entropy": F.when(n > 0, entropy).otherwise(F.lit(0.0)),
        "params": F.when(query == "", F.lit(0.0)).otherwise(F.size(F.split(query, "&")).cast("double")),
        "fragment": F.contains(url, F.lit("#")).cast("double"),
        "suffix": F.element_at(F.split("host", r"\."), -1),
        "segment": F.regexp_extract("path", r"^/([^/]*)", 1),
    })


#: Folds of the labelled URLs: a training row's rates come from the other folds.
FOLDS = 5


def _fold() -> Column:
    return F.pmod(F.xxhash64("url"), F.lit(FOLDS))


def _rates(pages: DataFrame, key: str) -> DataFrame:
    """Of every key: smoothed share of blocked URLs among its labelled ones (null without any), and count of all its URLs."""
    per = pages.groupBy(key).agg(F.sum("label").alias("_bad"), F.count("label").alias("_known"), F.count(F.lit(1)).alias("_n"))
    return per.select(key, _share("_bad", "_known").alias(f"{key}_rate"), F.log1p("_n").alias(f"{key}_log_n"))


def _share(bad, known) -> Column:
    return F.when(F.col(known) > 0, (F.col(bad) + 1.0) / (F.col(known) + 2.0))


def _other_rates(labelled: DataFrame, key: str) -> DataFrame:
    """Of every key and fold: the share of blocked URLs among those of the key in other folds (null without any), so that
    no training row, and no copy of it, gives its own label away."""
    per = settle(labelled.groupBy(key, _fold().alias("fold")).agg(F.sum("label").alias("_in"), F.count(F.lit(1)).alias("_k")))
    every = per.groupBy(key).agg(F.sum("_in").alias("_all"), F.sum("_k").alias("_n"))
    rest = per.join(every, key).withColumn("_bad", F.col("_all") - F.col("_in")).withColumn("_known", F.col("_n") - F.col("_k"))
    return rest.select(key, "fold", _share("_bad", "_known").alias(f"{key}_rate"))


def judge(pages: DataFrame, rules=RULES, rounds: int = 12, depth: int = 4, seed: int = 7) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) of each page.

    Where a rule fits, its verdict holds.  URLs with a rule are the labelled ones: boosted trees learn block or allow
    from their lexical features (length, depth, digit ratio, entropy, parameters and suffix statistics) on at most
    TRAIN_ROWS rows, picked by a hash of the URL, and judge the rest: block when the score is at least 0.5.  Statistics
    cover every suffix and first path segment: rates are of all labelled rows (the overall rate where a key has none),
    suffix counts of all rows; a training row's rates leave out the labels of its own fold.  With no labelled row, or labels of one kind, that kind (allow if none) is the verdict.  Null URL or no ``://``: host and path are empty, the model judges.
    Repeated rows are judged alike, an empty table gives no rows, other columns are ignored.
    """
    host, path = host_path(F.col("url"))
    base = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    ruled = base.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn(
        "label", (F.col("_rule.verdict") == "block").cast("double"))
    labelled = lexical(ruled.filter(F.col("label").isNotNull()))
    suffixes, segments = settle(_rates(lexical(ruled), "suffix")), settle(_rates(labelled, "segment"))
    overall = labelled.agg(F.count(F.lit(1)), F.avg("label")).first()

    def filled(df):
        return df.fillna({"suffix_rate": overall[1] or 0.0, "segment_rate": overall[1] or 0.0, "suffix_log_n": 0.0})

    def featured(df):
        return filled(df.join(suffixes, "suffix", "left").join(segments, "segment", "left"))

    def learned(df):
        met = df.withColumn("fold", _fold()).join(suffixes.drop("suffix_rate"), "suffix", "left")
        for key in ("suffix", "segment"):
            met = met.join(_other_rates(labelled, key), [key, "fold"], "left")
        return filled(met)

    if overall[0] and 0 < overall[1] < 1:
        some = labelled.orderBy(F.xxhash64("url"), "url").limit(TRAIN_ROWS)
        join = VectorAssembler(inputCols=FEATURES, outputCol="features")
        train = settle(learned(some).select("label", *FEATURES)).repartition(2)
        model = GBTClassifier(maxIter=rounds, maxDepth=depth, maxBins=32, seed=seed).fit(join.transform(train))
        scored = model.transform(join.transform(featured(lexical(ruled))))
        scored = scored.withColumn("block_score", vector_to_array("probability")[1])
    else:
        scored = ruled.withColumn("block_score", F.lit(float(overall[1] or 0.0)))
    own = F.when(F.col("block_score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"),
                         F.coalesce("_rule.verdict", own).alias("verdict"), "block_score")
