"""Fixture views over the driver tables (see FIXTURES.md §2).

The driver tables hold invented prose, so the hotel word lists match nothing;
queries pass these fixture lexicons instead.  Every view reads a driver table,
so its work grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values of the fixtures (FIXTURES.md §2).
# ---------------------------------------------------------------------------
FX_ADJECTIVES = frozenset("economy standard promo medium small large red blue hot cold old new".split())
FX_NOUNS = frozenset("ring widget bolt gear gizmo plate anvil rod".split())
FX_NOISE = frozenset(["rod"])
FX_GENERIC = frozenset(["standard", "economy", "plate"])
FX_PRAISE = frozenset(["anvil"])
FX_FUNCTIONAL = frozenset(["hot", "cold", "red"])
FX_ABSTRACT = frozenset(["promo"])
FX_DOMAIN_NOUNS = frozenset(["widget", "gear"])
FX_WHITELIST = frozenset(["bolt", "gizmo"])

# (lemma, sense number, domain) rows of a small word-net-like sense table.
FX_SENSES = [
    ("ring", 1, "noun.artifact"), ("ring", 2, "noun.act"),
    ("widget", 1, "noun.artifact"),
    ("bolt", 1, "noun.artifact"), ("bolt", 2, "noun.event"), ("bolt", 3, "noun.act"),
    ("gear", 1, "noun.artifact"), ("gear", 2, "noun.artifact"),
    ("gizmo", 1, "noun.artifact"),
    ("plate", 1, "noun.artifact"), ("plate", 2, "noun.food"),
    ("anvil", 1, "noun.artifact"),
    ("rod", 1, "noun.object"), ("rod", 2, "noun.artifact"),
    ("standard", 1, "noun.cognition"), ("standard", 2, "noun.attribute"),
    ("economy", 1, "noun.state"), ("economy", 2, "noun.act"), ("economy", 3, "noun.group"),
    ("promo", 1, "noun.communication"),
    ("medium", 1, "noun.state"), ("medium", 2, "noun.substance"),
    ("cold", 1, "noun.state"),
    ("kindness", 1, "noun.attribute"), ("fear", 1, "noun.feeling"), ("arrival", 1, "noun.event"),
]

# (word, pos tag, lemma, entity type, is_alpha) rows of the token lexicon.
def fx_token_lexicon_rows():
    rows = []
    for w in sorted(FX_ADJECTIVES):
        rows.append((w, "JJ", w, None))
    for w in sorted(FX_NOUNS):
        rows.append((w, "NN", w, None))
    for w, lemma in [("rings", "ring"), ("widgets", "widget"), ("bolts", "bolt"), ("gears", "gear")]:
        rows.append((w, "NNS", lemma, None))
    for w in ["the", "a", "an", "this", "that"]:
        rows.append((w, "DT", w, None))
    for w in ["it", "they", "we", "i", "you"]:
        rows.append((w, "PRP", w, None))
    for w in ["and", "or", "but"]:
        rows.append((w, "CC", w, None))
    for w in ["one", "two", "three"]:
        rows.append((w, "CD", w, "CARDINAL"))
    return rows


# Six ranked categories over the fixture words; anything else is the default.
FX_CATEGORIES = [
    ("Fasteners", "bolt rod"),
    ("Machinery", "gear widget gizmo"),
    ("Hardware", "ring anvil plate"),
    ("Finish", "red blue"),
    ("Temperature", "hot cold"),
    ("Pricing", "economy promo"),
]

# About twenty function words per language.
FX_LANG_STOPWORDS = {
    "en": "the and of to in is it that for on with as was by at be this are or from",
    "fr": "le la les de des du un une et est en que qui dans pour pas sur au aux ne",
    "de": "der die das und ist nicht ein eine zu den mit von sich des auf für im dem auch es",
    "es": "el la los las de del y que en un una es por con para se no al lo su",
}

# Synonyms and department hints of the rule fixtures.
FX_SYNONYMS = {"widget": ["gizmo"], "ring": ["rod"], "gear": ["anvil"]}
FX_DEPT_HINTS = [("widget", "Tools"), ("ring", "Parts"), ("plate", "Kitchen")]

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------------------
# review views
# ---------------------------------------------------------------------------

def documents_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reviews; text work per row is heavy, so few input partitions are spread."""
    from aspectra.functions.ops import spread
    d = spread(table(spark, sf_dir, "documents"), "doc_id")
    return d.select(
        F.col("doc_id").alias("review_key"),
        F.col("doc_id").alias("review_id"),
        F.col("source").alias("organization_id"),
        F.col("text"),
        F.col("lang"),
    )


def catalog_text() -> F.Column:
    return F.lower(F.concat_ws(" ", F.col("p_type"), F.col("p_name")))


def catalog_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("review_key"), F.col("p_brand"), catalog_text().alias("text"))


def order_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review per order: part texts joined by ' ; ' in line order."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                                 "l_extendedprice")
    p = table(spark, sf_dir, "part").select("p_partkey", catalog_text().alias("ptext"))
    j = li.join(p, li.l_partkey == p.p_partkey)
    g = j.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                                             "ptext"))).alias("lines"))
    return g.select(
        F.col("l_orderkey").alias("review_key"),
        F.col("l_orderkey").alias("review_id"),
        F.array_join(F.transform("lines", lambda x: x["ptext"]), " ; ").alias("text"),
    )


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase vectors: embeddings joined to part names."""
    e = table(spark, sf_dir, "embeddings")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return e.join(p, e.vec_id == p.p_partkey).select(
        F.col("vec_id"),
        F.concat_ws(" ", F.col("p_name"), F.col("vec_id").cast("string")).alias("phrase"),
        F.col("embedding"),
        F.col("label"),
    )


def fx_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster labels: embedding label, every 37th vector noise, two vectors in a small cluster 10."""
    ph = phrases(spark, sf_dir)
    return ph.withColumn(
        "cluster",
        F.when(F.col("vec_id") % 37 == 0, F.lit(-1))
        .when(F.col("vec_id") < 2, F.lit(10))
        .otherwise(F.col("label")).cast("int"),
    )


def kpi_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KPI labels derived from part names: every distinct name and every distinct noun, title-cased."""
    p = table(spark, sf_dir, "part").select("p_name")
    names = p.select(F.initcap("p_name").alias("kpi"))
    nouns = p.select(F.initcap(F.element_at(F.split("p_name", " "), -1)).alias("kpi"))
    return names.unionByName(nouns).distinct()


def department_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_name").alias("department"), F.col("r_regionkey").alias("pos"))


def aspect_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aspect sentiment rows from events (FIXTURES.md: aspect_scores)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").alias("review_id"),
        F.floor(F.col("event_id") / 400).cast("long").alias("review_part"),
        F.col("event_id").alias("pos"),
        F.col("event_type").alias("raw_label"),
        F.when(F.col("event_type").isin("purchase", "signup"), "Positive")
        .when(F.col("event_type") == "error", "Negative")
        .otherwise("Neutral").alias("label"),
        # value/500 rounded to 3 digits == round(2*value)/1000, exact in double for 2-decimal values
        (F.round(F.least(F.col("value"), F.lit(500.0)) * 2, 0) / 1000).alias("confidence"),
    )


def pred_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lb = table(spark, sf_dir, "labels")
    return lb.select(F.col("doc_id"), F.col("quality").cast("long").alias("y_true"),
                     (1 - F.col("toxic")).cast("long").alias("y_pred"))


# Sentiment word lists of the built-in lexicon scorer (E1): words that occur in the
# driver documents, and, for the catalogue aspect chain, catalogue adjectives.
FX_POSITIVE = frozenset("best good great excellent nice love perfect amazing".split())
FX_NEGATIVE = frozenset("idiot trash worthless moron pathetic stupid loser disgusting hate awful terrible worst".split())
FX_ASPECT_POSITIVE = frozenset("new promo large".split())
FX_ASPECT_NEGATIVE = frozenset("old economy small".split())


def orders_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order reviews with the customer as organisation (ID, ORGANIZATION_ID, text)."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("review_key"),
                                              F.col("o_custkey").alias("organization_id"))
    return order_reviews(spark, sf_dir).join(o, "review_key", "left")
