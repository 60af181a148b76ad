"""Record linkage: blocking by equi-joins, Fellegi-Sunter scoring, components."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import FIELD_WEIGHTS, MERGE_THRESHOLD, NAME_SIMILARITY, canonical_email, canonical_phone, jaro_winkler, log_ratio, sigmoid
from tidemark.plans.storage import connected_components, freed, stored

BLOCKS = ("email_c", "phone_c", "kyc_doc_number", "name_c")


def canonical(records: DataFrame) -> DataFrame:
    """Canonical e-mail, phone and name beside the raw ones."""
    return records.withColumns({"email_c": canonical_email(F.col("email")), "phone_c": canonical_phone(F.col("phone")), "name_c": F.lower("full_name")})


#: Blocks of up to so many records meet pair by pair; larger ones by the classes of ``_refined``.
BOUND = 64
KEYS = ("email", "phone", "kyc_doc")
OWN = {"email": "email_c", "phone": "phone_c", "kyc_doc": "kyc_doc_number"}


def links_by_name(mine: int, other: int, same_dob: bool) -> bool:
    """Whether two records of one name match whatever their values: ``mine`` and ``other`` say, bit by bit of ``KEYS``, which keys they have.

    Keys that both have are taken to differ, since equal ones match by themselves;
    birth dates are equal or, without ``same_dob``, one is missing.
    """
    llr = lambda field, agree: math.log(FIELD_WEIGHTS[field][0] / FIELD_WEIGHTS[field][1]) if agree else math.log((1 - FIELD_WEIGHTS[field][0]) / (1 - FIELD_WEIGHTS[field][1]))
    score = llr("name", True) + (llr("dob", True) if same_dob else 0.0)
    return score + sum(llr(k, False) for i, k in enumerate(KEYS) if mine & other & (1 << i)) >= MERGE_THRESHOLD


def candidates(records: DataFrame, bound: int = BOUND) -> DataFrame:
    """Pairs ``(a, b)`` of record ids, a < b, that agree on a blocking key.

    A block of up to ``bound`` records gives all its pairs. Of a larger one every
    record meets its least partner in each class of records that it matches, so
    the rows grow with the records and not with their pairs, and nothing is lost:
    components and best candidates are those of all pairs.
    """
    out, large = None, None
    for key in BLOCKS:
        block = Window.partitionBy("k")
        side = records.where(F.col(key).isNotNull()).select("record_id", F.col(key).alias("k")).distinct()
        side = side.withColumn("n", F.count("*").over(block))
        met = side.where(F.col("n") <= bound).withColumn("met", F.collect_list("record_id").over(block.orderBy("record_id").rowsBetween(-bound, -1)))
        pairs = met.select(F.explode("met").alias("a"), F.col("record_id").alias("b"))
        more = side.where(F.col("n") > bound).select("record_id", F.lit(key).alias("key"))
        out, large = (pairs, more) if out is None else (out.union(pairs), large.union(more))
    large = stored(large, "large-blocks")
    if not large.isEmpty():
        out = out.union(_refined(records, large))
    return out.distinct()


def _refined(records: DataFrame, large: DataFrame) -> DataFrame:
    """Pairs of blocks above the bound: each record with the least other of each class that it matches.

    Records that share an e-mail, phone or document match, so such a block is one
    class. Records of one name match by what they have alone: their birth dates
    and which keys are missing (``links_by_name``), so a name's classes are its
    birth dates times the eight sets of keys. All pairs between two matching
    classes match; each record meets the least of the other class, and so their
    component is whole. For the best candidate a record also meets the least that
    shares no key with it, found in as many rounds as there are keys.
    """
    slim = records.select("record_id", "name_c", "dob", *OWN.values()).distinct()
    own = large.join(slim, "record_id")
    mask = sum((F.col(c).isNotNull().cast("int") * (1 << i) for i, c in enumerate(OWN.values())), F.lit(0))
    text = lambda *xs: F.to_json(F.struct(*[(x if isinstance(x, Column) else F.lit(x)).cast("string").alias(f"k{i}") for i, x in enumerate(xs)]))
    name = own.where("key = 'name_c'").withColumn("mask", mask)
    has, none = F.col("dob").isNotNull(), F.col("dob").isNull()
    groups = F.array_compact(F.array(F.when(has, text("dob", F.col("name_c"), F.col("dob"), F.col("mask"))), text("any", F.col("name_c"), F.col("mask")), F.when(none, text("null", F.col("name_c"), F.col("mask")))))
    asked = []
    for mine in range(8):
        for other in range(8):
            is_mine = F.col("mask") == mine
            if links_by_name(mine, other, True):
                asked.append(F.when(is_mine & has, text("dob", F.col("name_c"), F.col("dob"), F.lit(other))))
            if links_by_name(mine, other, False):
                asked += [F.when(is_mine & none, text("any", F.col("name_c"), F.lit(other))), F.when(is_mine & has, text("null", F.col("name_c"), F.lit(other)))]
    cols = ["record_id", *OWN.values()]
    members = name.select(F.explode(groups).alias("g"), *cols)
    asks = name.select(F.explode(F.array_compact(F.array(*asked))).alias("g"), *cols)
    nothing = F.lit(None).cast("string")
    for key in BLOCKS[:3]:
        rows = own.where(F.col("key") == key).withColumn("g", text("key", key, F.col(key)))
        members = members.union(rows.select("g", *cols))
        # a partner by document scores by e-mail or phone instead, where it shares them
        avoid = [F.col(c) if key == "kyc_doc_number" and c != key else nothing for c in OWN.values()]
        asks = asks.union(rows.select("g", "record_id", *[a.alias(c) for a, c in zip(avoid, OWN.values(), strict=True)]))
    members = stored(members.select("g", F.struct(*cols).alias("m")), "class-members")
    asks = stored(asks.withColumns({f"not_{c}": F.lit(None).cast(asks.schema[c].dataType) for c in cols}), "class-asks")
    barred = [f"not_{c}" for c in cols]
    out, held = None, [members]
    while not asks.isEmpty():  # each round bars one more of a record's id and keys, so there are five at most
        held.append(asks)
        needs = asks.select("g", *barred).distinct()
        free = lambda c: F.coalesce(F.col(f"m.{c}") != F.col(f"not_{c}"), F.lit(True))
        best = members.join(needs, "g").where(free(cols[0]) & free(cols[1]) & free(cols[2]) & free(cols[3]))
        best = best.groupBy("g", *barred).agg(F.min_by("m", "m.record_id").alias("m")).withColumnRenamed("g", "g_")
        best = best.toDF("g_", *[f"b_{c}" for c in cols], "m")
        same = F.col("g") == F.col("g_")
        for c in cols:
            same &= F.col(f"not_{c}").eqNullSafe(F.col(f"b_{c}"))
        clash = F.coalesce(*[F.when(F.col(f"m.{c}") == F.col(c), F.lit(c)) for c in cols])
        met = stored(asks.join(best, same).select("g", *cols, *barred, "m", clash.alias("clash")), "class-met")
        held.append(met)
        found = met.where(F.col("m.record_id") != F.col("record_id")).select(F.least("record_id", "m.record_id").alias("a"), F.greatest("record_id", "m.record_id").alias("b"))
        out = found if out is None else out.union(found)
        asks = met.where("clash is not null").select("g", *cols, *[F.when(F.col("clash") == c, F.col(c)).otherwise(F.col(f"not_{c}")).alias(f"not_{c}") for c in cols])
        asks = stored(asks, "class-asks")
    done = stored(out.distinct(), "class-pairs")
    freed(*held, asks)
    return done


def scored(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, method, score, confidence, matched`` of candidate pairs; exact keys come before the probabilistic score."""
    names = ("email_c", "phone_c", "name_c", "dob", "kyc_doc_number")
    l = records.select(F.col("record_id").alias("a"), *[F.col(n).alias(f"{n}_l") for n in names])
    r = records.select(F.col("record_id").alias("b"), *[F.col(n).alias(f"{n}_r") for n in names])
    p = pairs.join(l, "a").join(r, "b")
    same = lambda n: F.col(f"{n}_l") == F.col(f"{n}_r")
    p = p.withColumn("similarity", jaro_winkler("name_c_l", "name_c_r"))
    score = sum([log_ratio(same(n), f) for n, f in (("email_c", "email"), ("phone_c", "phone"), ("dob", "dob"), ("kyc_doc_number", "kyc_doc"))], log_ratio(F.col("similarity") >= NAME_SIMILARITY, "name"))
    p = p.withColumn("score", score)
    exact = F.when(same("email_c"), "exact_email").when(same("phone_c"), "exact_phone").when(same("kyc_doc_number"), "exact_kyc")
    matched = exact.isNotNull() | (F.col("score") >= MERGE_THRESHOLD)
    loose = F.round(F.when(F.col("score") >= MERGE_THRESHOLD, sigmoid(F.col("score"))).otherwise(F.least(sigmoid(F.col("score")), F.lit(0.5))), 4)
    confidence = F.when(exact == "exact_email", 0.99).when(exact == "exact_phone", 0.98).when(exact == "exact_kyc", 0.995).otherwise(loose)
    return p.select("a", "b", F.coalesce(exact, F.lit("probabilistic")).alias("method"), F.round("score", 4).alias("score"), confidence.alias("confidence"), matched.alias("matched"))


def best_candidates(matches: DataFrame) -> DataFrame:
    """Each record's best matched partner: greatest confidence, then least id."""
    both = matches.where("matched").select("a", "b", "method", "confidence")
    both = both.union(both.select("b", "a", "method", "confidence"))
    w = Window.partitionBy("a").orderBy(F.col("confidence").desc(), "b")
    return both.withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("a").alias("record_id"), F.col("b").alias("best_id"), "method", "confidence")


def resolve(records: DataFrame, matches: DataFrame) -> DataFrame:
    """``record_id, canonical_id``: the least id of the component, the record itself if it is alone."""
    comp = connected_components(matches.where("matched").select("a", "b"))
    return records.select("record_id").join(comp.withColumnRenamed("node", "record_id"), "record_id", "left").select("record_id", F.coalesce("component", "record_id").alias("canonical_id"))


def annotate(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Events under their canonical customer, with how that came about; unmapped ones are first seen."""
    m = mapping.select(F.col("customer_id").alias("__raw"), "canonical_id", "confidence", "method")
    out = events.join(m, F.col("customer_id") == F.col("__raw"), "left")
    identity = F.struct(F.col("customer_id").alias("raw"), F.coalesce("canonical_id", "customer_id").alias("resolved"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("method", F.lit("first_seen")).alias("method"))
    return out.withColumn("identity", identity).withColumn("customer_id", F.col("identity.resolved")).drop("__raw", "canonical_id", "confidence", "method")


def new_records(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """Insert-or-get: incoming records whose source and source id the registry lacks, one each."""
    return incoming.dropDuplicates(["source_system", "source_customer_id"]).join(registry, ["source_system", "source_customer_id"], "left_anti")


def lookup(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    return incoming.join(registry, ["source_system", "source_customer_id"], "left")



def add_edges(edges: DataFrame, incoming: DataFrame) -> DataFrame:
    """Undirected edges ``(a, b, method, confidence)``, once each: the surest stays, ties to the first method."""
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    both = edges.unionByName(incoming).select(*ends, "method", "confidence").where("a <> b")
    w = Window.partitionBy("a", "b").orderBy(F.col("confidence").desc(), "method")
    return both.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def update_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, component)`` after new ``edges(a, b)``, from the labels before them: no old edge is read again.

    The new edges are contracted to edges between labels; a node that is new is
    its own. Only components that an edge joins change, and the least node
    names a component, as in a run over all edges. The result is stored.
    """
    named = labels.select("node", "component")
    ends = edges.select("a", "b", F.explode(F.array("a", "b")).alias("node"))
    found = ends.join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    small = found.groupBy("a", "b").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    moved = connected_components(small.select(F.col("least").alias("a"), F.col("most").alias("b")))
    every = named.join(ends.select("node").distinct(), "node", "full_outer").withColumn("component", F.coalesce("component", "node"))
    every = every.join(moved.toDF("component", "now"), "component", "left")
    done = stored(every.select("node", F.coalesce("now", "component").alias("component")), "labels")
    freed(moved)
    return done
