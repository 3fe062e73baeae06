"""The claim graph as node and edge tables, and the features read from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.exchange import fits_broadcast, hot_keys, key_counts, lookup_join, sized_join
from riskloom.fixed import ATTRIBUTE_RELATIONS, LOCATION_FEATURES, OBSOLETE_RELATIONS, RELATED_CAP
from riskloom.operators.normalize import with_location
from riskloom.session import materialize


def merge_distinct(df: DataFrame, key: list[str]) -> DataFrame:
    """One row per key; the other columns must be functions of the key."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(*[F.max(c).alias(c) for c in rest]) if rest else df.select(*key).distinct()


def claims_with_policy(claims: DataFrame, policies: DataFrame) -> DataFrame:
    """Claims whose policy exists, with its premium and deductible."""
    return claims.join(policies.select("policy_id", "premium", "deductible"), "policy_id")


def entity_nodes(policies: DataFrame, claims: DataFrame) -> DataFrame:
    """Policy and Claim nodes. Keys are unique by contract, so nothing is merged; a
    claim without a policy is no node."""
    policy = policies.select(F.lit("Policy").alias("label"), F.col("policy_id").alias("node_id"), "premium", "deductible")
    claim = claims.join(policies.select("policy_id"), "policy_id", "left_semi").select(
        F.lit("Claim").alias("label"),
        F.col("claim_id").alias("node_id"),
        "claim_date",
        "claim_type",
        "claimed_amount",
        "total_claim_amount",
        "collision_type",
        "incident_severity",
        "authorities_contacted",
        "incident_state",
        "incident_city",
        F.col("incident_hour_of_the_day").alias("incident_hour_of_day"),
        "number_of_vehicles_involved",
        "bodily_injuries",
        "witnesses",
        "police_report_available",
        "fraud_label",
    )
    return policy.unionByName(claim, allowMissingColumns=True)


def has_claim_edges(claims: DataFrame, policies: DataFrame) -> DataFrame:
    loaded = claims.join(policies.select("policy_id"), "policy_id", "left_semi")
    return loaded.select(F.col("policy_id").alias("src"), F.col("claim_id").alias("dst"), F.lit("HAS_CLAIM").alias("rel_type"))


def occurrences(claims: DataFrame) -> DataFrame:
    """Claims that have a location."""
    return with_location(claims).where("location_key is not null").select(
        "claim_id", "location_key", "incident_state", "incident_city"
    )


def location_nodes(occ: DataFrame) -> DataFrame:
    return merge_distinct(
        occ.select("location_key", F.col("incident_state").alias("state"), F.col("incident_city").alias("city")),
        ["location_key"],
    )


def occurred_at_edges(occ: DataFrame) -> DataFrame:
    return occ.select(F.col("claim_id").alias("src"), F.col("location_key").alias("dst"), F.lit("OCCURRED_AT").alias("rel_type"))


def attribute_edges(claims: DataFrame) -> DataFrame:
    """Edges from claims to the values of four attributes: linear in the claims, where
    linking claims that share a value would be quadratic."""
    pairs = [
        F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("dst"), F.lit(rel).alias("rel_type")))
        for c, rel, _, _ in ATTRIBUTE_RELATIONS
    ]
    return claims.select(F.col("claim_id").alias("src"), F.inline(F.array_compact(F.array(*pairs))))


def attribute_nodes(claims: DataFrame) -> DataFrame:
    pairs = [
        F.when(F.col(c).isNotNull(), F.struct(F.lit(label).alias("label"), F.col(c).alias("node_id")))
        for c, _, label, _ in ATTRIBUTE_RELATIONS
    ]
    return merge_distinct(claims.select(F.inline(F.array_compact(F.array(*pairs)))), ["label", "node_id"])


def drop_obsolete(edges: DataFrame) -> DataFrame:
    """Without the pairwise attribute links of earlier graph versions."""
    return edges.where(~F.col("rel_type").isin(OBSOLETE_RELATIONS))


def location_counts(occ: DataFrame) -> DataFrame:
    return key_counts(occ, "location_key")


def shared_location_links(occ: DataFrame) -> DataFrame:
    """The SHARES_LOCATION_WITH relation in a form that is linear in the claims.

    All claims at a location share it with one another, so the relation is told by one
    link of each to the first of them, with the number of pairs at the location:
    `src, dst, location_pairs`. `related_claims` gives the neighbours of claims.
    """
    counts = materialize(occ.groupBy("location_key").agg(F.count(F.lit(1)).alias("n"), F.min("claim_id").alias("src")), "locations")
    shared = counts.where("n > 1").select("location_key", "src", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("location_pairs"))
    hot = hot_keys(counts.select("location_key", "n"), "location_key")
    joined = lookup_join(occ.select("claim_id", "location_key"), shared, "location_key", "claim_id", hot, "inner")
    return joined.where("claim_id <> src").select("src", F.col("claim_id").alias("dst"), "location_pairs")


def shares_location_edges(occ: DataFrame) -> DataFrame:
    return shared_location_links(occ).select("src", "dst", F.lit("SHARES_LOCATION_WITH").alias("rel_type"))


def shared_pair_total(occ: DataFrame) -> DataFrame:
    """How many pairs share a location, by arithmetic on the counts."""
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return location_counts(occ).agg(F.coalesce(F.sum(pairs.cast("long")), F.lit(0)).alias("n"))


def top_shared_locations(occ: DataFrame, n: int = 10) -> DataFrame:
    """The locations with most claims, among those with more than one."""
    counts = occ.groupBy("location_key").agg(
        F.max("incident_state").alias("state"), F.max("incident_city").alias("city"), F.count(F.lit(1)).alias("claim_count")
    )
    return counts.where("claim_count > 1").orderBy(F.desc("claim_count"), "location_key").limit(n)


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows per node label and per edge type."""
    by_label = nodes.groupBy(F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    by_type = edges.groupBy(F.col("rel_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return by_label.select(F.lit("node").alias("kind"), "name", "n").unionByName(
        by_type.select(F.lit("edge").alias("kind"), "name", "n")
    )


def related_claims(occ: DataFrame, of: DataFrame | None = None, cap: int = RELATED_CAP) -> DataFrame:
    """Per claim, the first `cap` other claims at its location in id order (the result
    the graph query returns), for the claims `of` or all.

    The first cap + 1 ids of a location serve all its claims. They are picked by a
    limited rank, which keeps that many rows per location before the shuffle.
    """
    everyone = occ.select("claim_id", "location_key")
    hot = hot_keys(location_counts(everyone), "location_key")
    subjects, peers = everyone, everyone
    if of is not None:
        subjects = of.select("claim_id", "location_key")
        wanted = subjects.select("location_key").where("location_key is not null").distinct()
        peers = lookup_join(everyone, wanted, "location_key", "claim_id", hot, "inner")
        hot = hot_keys(location_counts(subjects), "location_key")  # these may lack a location
    by_id = Window.partitionBy("location_key").orderBy("claim_id")
    first = (
        peers.withColumn("_rank", F.row_number().over(by_id))
        .where(F.col("_rank") <= cap + 1)
        .groupBy("location_key")
        .agg(F.array_sort(F.collect_list("claim_id")).alias("_first"))
    )
    joined = lookup_join(subjects, first, "location_key", "claim_id", hot)
    others = F.slice(F.array_remove(F.coalesce("_first", F.array().cast("array<string>")), F.col("claim_id")), 1, cap)
    return joined.select("claim_id", others.alias("related_claim_ids"), F.size(others).cast("long").alias("related_count"))


def location_features(claims: DataFrame) -> DataFrame:
    """Peers at the same location over the whole graph. Each peer is one shared-location
    edge, so the degree is the same number and no pair is formed."""
    located = with_location(claims).select("claim_id", "location_key")
    counts = materialize(location_counts(located), "location_counts")
    known = counts.where("location_key is not null")
    joined = lookup_join(located, known, "location_key", "claim_id", hot_keys(counts, "location_key"))
    peers = F.coalesce(F.col("n") - 1, F.lit(0)).cast("long")
    return joined.select("claim_id", peers.alias("location_claim_count"), peers.alias("shared_location_degree"))


def split_safe_location_features(claims: DataFrame) -> DataFrame:
    """Training claims at the claim's location; the degree leaves out the claim itself."""
    located = with_location(claims).select("claim_id", "split", "location_key")
    counts = materialize(
        located.groupBy("location_key").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "train").alias("train_n")
        ),
        "location_counts",
    )
    known = counts.where("location_key is not null and train_n > 0").select("location_key", "train_n")
    joined = lookup_join(located, known, "location_key", "claim_id", hot_keys(counts, "location_key"))
    count = F.coalesce("train_n", F.lit(0)).cast("long")
    degree = F.when(F.col("split") == "train", F.greatest(count - 1, F.lit(0))).otherwise(count)
    return joined.select(
        "claim_id", "split", count.alias(LOCATION_FEATURES[0]), degree.cast("long").alias(LOCATION_FEATURES[1])
    )


def lookup_counts(df: DataFrame, counts: DataFrame, column: str, name: str, small: bool) -> DataFrame:
    """Add the training count of the column's value from a frequency table `value, n,
    train_n`; unseen values count 0."""
    known = counts.select(F.col("value").alias(column), F.col("train_n").alias("_n"))
    rows = counts.select(F.col("value").alias(column), "n")
    found = sized_join(df, known, column, "claim_id", small, rows)
    return found.withColumn(name, F.coalesce("_n", F.lit(0)).cast("long")).drop("_n")


def split_safe_attribute_features(claims: DataFrame) -> DataFrame:
    """Training peers that share each of four attributes."""
    columns = [c for c, _, _, _ in ATTRIBUTE_RELATIONS]
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]
    counts = materialize(
        claims.select("split", F.inline(F.array(*pairs)))
        .where("value is not null")
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "train").alias("train_n")),
        "attribute_counts",
    )
    small = fits_broadcast(counts, "value")
    out = claims.select("claim_id", "split", *columns)
    for column, _, _, name in ATTRIBUTE_RELATIONS:
        out = lookup_counts(out, counts.where(F.col("column") == column), column, name, small)
        out = out.withColumn(name, F.when(F.col("split") == "train", F.greatest(F.col(name) - 1, F.lit(0))).otherwise(F.col(name)))
    return out.select("claim_id", "split", *[name for _, _, _, name in ATTRIBUTE_RELATIONS])


def feature_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """Smallest and largest value per feature."""
    one_row = df.agg(*[F.min(c).alias(f"min_{c}") for c in columns], *[F.max(c).alias(f"max_{c}") for c in columns])
    rows = [
        F.struct(F.lit(c).alias("feature"), F.col(f"min_{c}").alias("min_value"), F.col(f"max_{c}").alias("max_value"))
        for c in columns
    ]
    return one_row.select(F.inline(F.array(*rows)))


def all_nodes(policies: DataFrame, claims: DataFrame) -> DataFrame:
    """Rows `label, node_id` of every node."""
    loaded = claims.join(policies.select("policy_id"), "policy_id", "left_semi")
    parts = [
        entity_nodes(policies, claims).select("label", "node_id"),
        location_nodes(occurrences(loaded)).select(F.lit("IncidentLocation").alias("label"), F.col("location_key").alias("node_id")),
        attribute_nodes(loaded),
    ]
    return reduce(DataFrame.unionByName, parts)


def property_nodes(policies: DataFrame, claims: DataFrame) -> dict[str, DataFrame]:
    """A table for each label: `node_id` and the properties that nodes of it carry. A
    claim without a policy is no node. The claims that are nodes are written once, as
    every label but one is read from them."""
    named = {"claim_description": "description", "incident_hour_of_the_day": "incident_hour_of_day"}
    carried = [
        "claim_date", "claim_type", "claim_description", "claimed_amount", "approved_amount", "status", "fraud_label", "incident_date", "collision_type",
        "incident_severity", "authorities_contacted", "incident_state", "incident_city", "incident_hour_of_the_day", "number_of_vehicles_involved",
        "bodily_injuries", "witnesses", "police_report_available", "total_claim_amount",
    ]
    claim = [F.col(c).alias(named.get(c, c)) for c in carried]
    loaded = claims.select("policy_id", "claim_id", *carried).join(policies.select("policy_id"), "policy_id", "left_semi")
    loaded = materialize(loaded.drop("policy_id"), "loaded")
    nodes = {
        "Policy": policies.select(
            F.col("policy_id").alias("node_id"), "policy_type", F.col("policy_start_date").alias("policy_start"), F.col("policy_end_date").alias("policy_end"),
            "premium", "deductible", "coverage_amount", "status",
        ),
        "Claim": loaded.select(F.col("claim_id").alias("node_id"), *claim, F.col("claim_type").alias("incident_type"), F.col("claimed_amount").alias("claim_amount_source")),
        "IncidentLocation": location_nodes(occurrences(loaded)).withColumnRenamed("location_key", "node_id"),
    }
    attributes = attribute_nodes(loaded)
    return nodes | {label: attributes.where(F.col("label") == label).select("node_id") for _, _, label, _ in ATTRIBUTE_RELATIONS}


def linear_edges(policies: DataFrame, claims: DataFrame) -> DataFrame:
    """Rows `src, dst, rel_type` of every edge type that is linear in the claims, from the
    ends of the edges, which are written once."""
    ends = claims.select("policy_id", "claim_id", "incident_city", *[c for c, _, _, _ in ATTRIBUTE_RELATIONS])
    loaded = materialize(ends.join(policies.select("policy_id"), "policy_id", "left_semi"), "loaded")
    has_claim = loaded.select(F.col("policy_id").alias("src"), F.col("claim_id").alias("dst"), F.lit("HAS_CLAIM").alias("rel_type"))
    parts = [has_claim, occurred_at_edges(occurrences(loaded)), attribute_edges(loaded)]
    return reduce(DataFrame.unionByName, parts)
