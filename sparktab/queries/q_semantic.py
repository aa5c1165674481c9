"""Ontology, alias, profile and match queries; the ontology is made from the parts and the columns are named after them."""

from pyspark.sql import functions as F

from ..functions.text import string_similarity
from ..operators import profile, semantic
from ..operators.neighbors import cosine_top_k
from ..sources import ontology
from .bases import ORDERS, orders, query, round_all, table, with_

# Concept = noun of the part name; aliases = full names and, in another language, the bare adjective (shared by many nouns).
ONTOLOGY = """
pn AS (SELECT DISTINCT p_name, split_part(p_name, ' ', 2) AS noun, split_part(p_name, ' ', 1) AS adj FROM part),
al AS (SELECT noun AS concept_id, 'en' AS language, p_name AS text FROM pn UNION ALL SELECT noun, 'xx', adj FROM pn),
co AS (SELECT split_part(p_name, ' ', 2) AS concept_id, min(p_size)::DOUBLE AS low, max(p_size)::DOUBLE * 0.96 AS high FROM part GROUP BY 1)
"""


def _ontology_text(spark, sf):
    """One JSON document holding all concepts of the parts table."""
    p = table(spark, sf, "part").select("p_name", F.split("p_name", " ")[1].alias("noun"), F.split("p_name", " ")[0].alias("adj"), "p_size")
    spans = p.groupBy("noun").agg(F.min("p_size").cast("double").alias("lo"), (F.max("p_size") * 0.96).cast("double").alias("hi"))
    names = p.select("noun", "adj", "p_name").distinct()
    packed = names.groupBy("noun").agg(F.array_sort(F.collect_list("p_name")).alias("en"), F.array_sort(F.collect_list("adj")).alias("xx"))
    body = F.struct(
        F.lit("part").alias("category"), F.when(F.length("noun") % 2 == 0, "numeric").otherwise("categorical").alias("data_type"), F.lit("piece").alias("unit"),
        F.array("lo", "hi").alias("range"), F.struct("en", "xx").alias("aliases"), F.array(F.lit("ECONOMY"), F.lit("Small")).alias("allowed_values"),
        F.lit("binary numeric").alias("patterns"))
    concepts = packed.join(spans, "noun").select("noun", body.alias("body"))
    return concepts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("noun", F.to_json("body").alias("b"))))).alias("m")).select(
        F.concat(F.lit('{"ontology_name":"parts","version":"1","concepts":{'), F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(
            F.lit('"'), e["key"], F.lit('":'), e["value"])), ","), F.lit("}}")).alias("json"))


def _ontology(spark, sf):
    concepts = ontology.concepts_from_text(_ontology_text(spark, sf))
    return concepts, ontology.aliases_from_concepts(concepts)


@query("s3_ontology_concepts", with_(ONTOLOGY) + """
SELECT concept_id, 'part' AS category, CASE WHEN length(concept_id) % 2 = 0 THEN 'numeric' ELSE 'categorical' END AS data_type, 'piece' AS unit, round(low, 4) AS low, round(high, 4) AS high FROM co""")
def s3(spark, sf):
    return round_all(_ontology(spark, sf)[0].select("concept_id", "category", "data_type", "unit", "low", "high"), 4)


@query("c2_alias_rows", with_(ONTOLOGY) + "SELECT concept_id, language, text FROM al")
def c2(spark, sf):
    return _ontology(spark, sf)[1].select("concept_id", "language", "text")


@query("c3_alias_dedup", with_(ONTOLOGY) + """
SELECT lower(text) AS text, string_agg(DISTINCT concept_id, ',' ORDER BY concept_id) AS concepts, string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM al GROUP BY 1""")
def c3(spark, sf):
    found = semantic.dedup_aliases(_ontology(spark, sf)[1])
    return found.select("text", F.array_join("concepts", ",").alias("concepts"), F.array_join("languages", ",").alias("languages"))


# ---- columns named after parts ------------------------------------------------------------------

COLUMNS = """
cl AS (SELECT p_partkey, split_part(p_name, ' ', 2) AS noun, CASE p_partkey % 4 WHEN 0 THEN upper(replace(p_name, ' ', '__')) WHEN 1 THEN replace(p_name, ' ', '')
    WHEN 2 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) || '.x' ELSE split_part(p_name, ' ', 1) END || '_' || p_partkey AS name,
  p_partkey % 2 = 0 AS numeric, p_size AS uniq, p_size::DOUBLE AS mn, p_size * 1.01 AS mx, p_type FROM part),
nm AS (SELECT *, regexp_replace(trim(regexp_replace(regexp_replace(lower(name), '[_\\-./\\\\]+', ' ', 'g'), '\\s+', ' ', 'g')), '\\s+[0-9]+$', '') AS norm FROM cl)
"""


def _profiles(spark, sf):
    key, words = F.col("p_partkey"), F.split("p_name", " ")
    name = (
        F.when(key % 4 == 0, F.upper(F.replace("p_name", F.lit(" "), F.lit("__")))).when(key % 4 == 1, F.replace("p_name", F.lit(" "), F.lit("")))
        .when(key % 4 == 2, F.concat(words[1], F.lit(" "), words[0], F.lit(".x"))).otherwise(words[0])
    )
    from ..functions.text import normalize_text

    named = table(spark, sf, "part").withColumn("name", F.concat(name, F.lit("_"), key.cast("string")))
    return named.select(
        "name", words[1].alias("noun"), (key % 2 == 0).alias("numeric"), F.lit(False).alias("boolean"), F.lit(False).alias("datetime"),
        F.col("p_size").cast("long").alias("unique"), F.col("p_size").cast("double").alias("min_value"), (F.col("p_size") * 1.01).cast("double").alias("max_value"),
        F.array("p_type", F.lit("other")).alias("samples"), normalize_text(F.col("name")).alias("normalized_name"),
        F.array(F.lit("binary_numeric")).alias("patterns"))


EXACT = """
ex AS (SELECT norm, min(concept_id) AS concept_id, count(DISTINCT concept_id) AS n FROM (SELECT lower(text) AS norm, concept_id FROM al) GROUP BY 1),
cx AS (SELECT norm, min(concept_id) AS concept_id, count(DISTINCT concept_id) AS n FROM (SELECT replace(lower(text), ' ', '') AS norm, concept_id FROM al) GROUP BY 1),
mt AS (SELECT name, e.concept_id, 'exact' AS stage FROM nm JOIN ex e USING (norm) WHERE e.n = 1 UNION ALL
  SELECT name, c.concept_id, 'compact' FROM nm JOIN cx c ON c.norm = replace(nm.norm, ' ', '') WHERE nm.norm NOT IN (SELECT norm FROM ex) AND c.n = 1)
"""


@query("c6_exact_match", with_(ONTOLOGY, COLUMNS, EXACT) + "SELECT name, concept_id, stage FROM mt")
def c6(spark, sf):
    return semantic.match_exact(_profiles(spark, sf), _ontology(spark, sf)[1]).select("name", "concept_id", "stage")


@query("c11_concept_columns", with_(ONTOLOGY, COLUMNS, EXACT) + "SELECT concept_id, string_agg(name, ',' ORDER BY name) AS columns FROM mt GROUP BY 1")
def c11(spark, sf):
    matches = semantic.match_exact(_profiles(spark, sf), _ontology(spark, sf)[1]).withColumn("status", F.lit("KNOWN"))
    return semantic.concept_columns(matches).select("concept_id", F.array_join("columns", ",").alias("columns"))


EVIDENCE = """
ev AS (SELECT nm.name, nm.norm, co.concept_id,
  CASE WHEN length(co.concept_id) % 2 = 0 THEN nm.numeric::INT::DOUBLE ELSE CASE WHEN uniq <= 10 THEN 0.85 ELSE 0.0 END END AS dtype,
  CASE WHEN mn >= low AND mx <= high THEN 1.0 WHEN (greatest(0, low - mn) + greatest(0, mx - high)) / greatest(high - low, 1.0) <= 0.05 THEN 0.5 ELSE 0.0 END AS "range",
  CASE WHEN lower(p_type) IN ('economy', 'small') THEN 0.5 ELSE 0.0 END AS value, 0.0 AS pattern FROM nm, co)
"""


@query("c7_evidence", with_(ONTOLOGY, COLUMNS, EVIDENCE) + """
SELECT name, concept_id, dtype::DOUBLE AS dtype, "range"::DOUBLE AS "range", value::DOUBLE AS value, pattern::DOUBLE AS pattern FROM ev""")
def c7(spark, sf):
    found = semantic.evidence_of_all_pairs(_profiles(spark, sf), _ontology(spark, sf)[0])
    return found.select("name", "concept_id", *[F.col(c).cast("double").alias(c) for c in ("dtype", "range", "value", "pattern")])


RANKED = """
sc AS (SELECT ev.name, ev.concept_id, al.text, CASE WHEN norm = lower(al.text) THEN 1.0 WHEN replace(norm, ' ', '') = replace(lower(al.text), ' ', '') THEN 0.985 ELSE
    0.65 * len(list_intersect(string_split(norm, ' '), string_split(lower(al.text), ' '))) / len(list_distinct(list_concat(string_split(norm, ' '), string_split(lower(al.text), ' ')))) +
    0.35 * len(list_intersect(string_split(norm, ' '), string_split(lower(al.text), ' '))) / least(len(string_split(norm, ' ')), len(string_split(lower(al.text), ' '))) END AS ns,
  0.2 * value + 0.1 * dtype + 0.05 * "range" + 0.05 * pattern AS e FROM ev JOIN al USING (concept_id)),
bs AS (SELECT name, concept_id, max(round(0.6 * ns + e, 9)) AS s FROM sc GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY s DESC, concept_id) AS r FROM bs)
"""


@query("c8_weighted_rank", with_(ONTOLOGY, COLUMNS, EVIDENCE, RANKED) + "SELECT name, round(s, 6)::DOUBLE AS score, r::INTEGER AS rank FROM rk WHERE r <= 5")
def c8(spark, sf):
    concepts, aliases = _ontology(spark, sf)
    ranked = semantic.rank_concepts(_profiles(spark, sf), aliases, concepts, "token")
    rows = ranked.select("name", F.posexplode("ranked").alias("p", "x"))
    return round_all(rows.select("name", F.col("x.score").alias("score"), (F.col("p") + 1).cast("int").alias("rank")))


@query("c8_weighted_rank_chunked", with_(ONTOLOGY, COLUMNS, EVIDENCE, RANKED) + "SELECT name, round(s, 6)::DOUBLE AS score, r::INTEGER AS rank FROM rk WHERE r <= 5")
def c8c(spark, sf):
    """The plan for alias tables too large to send everywhere, on the same rows."""
    concepts, aliases = _ontology(spark, sf)
    ranked = semantic.rank_concepts(_profiles(spark, sf), aliases, concepts, "token", per_chunk=20)
    rows = ranked.select("name", F.posexplode("ranked").alias("p", "x"))
    return round_all(rows.select("name", F.col("x.score").alias("score"), (F.col("p") + 1).cast("int").alias("rank")))


@query("c8_weighted_match")
def c8m(spark, sf):
    concepts, aliases = _ontology(spark, sf)
    return semantic.accept_ranked(semantic.rank_concepts(_profiles(spark, sf), aliases, concepts)).select("name", "concept_id", "confidence", "margin")


@query("f4_string_similarity")
def f4(spark, sf):
    return table(spark, sf, "part").select("p_partkey", string_similarity(F.lower("p_name"), F.lower(F.concat_ws(" ", "p_type", "p_name"))).alias("similarity"))


# ---- vectors ------------------------------------------------------------------------------------

NEAR = """
u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings),
p AS (SELECT q.vec_id, d.vec_id AS nid, d.label, list_dot_product(q.e, d.e) / (q.n * d.n) AS s FROM u q JOIN u d ON q.vec_id <> d.vec_id),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, nid) AS k FROM p) WHERE k <= 5),
b AS (SELECT vec_id, label, max(s) AS s FROM t GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label::VARCHAR) AS k, lead(s) OVER (PARTITION BY vec_id ORDER BY s DESC, label::VARCHAR) AS s2 FROM b)
"""


@query("c9_embedding_decision", with_(NEAR) + """
SELECT 'v' || vec_id AS name, CASE WHEN s < 0.5 OR s - s2 < 0.05 THEN 'UNKNOWN' ELSE label::VARCHAR END AS concept_id,
  CASE WHEN s < 0.5 THEN 'below_threshold' WHEN s - s2 < 0.05 THEN 'below_margin' ELSE 'accepted' END AS reason,
  CASE WHEN s < 0.5 OR s - s2 < 0.05 THEN NULL ELSE round(coalesce(s - s2, s), 5) END AS margin FROM r WHERE k = 1""")
def c9(spark, sf):
    e = table(spark, sf, "embeddings")
    near = cosine_top_k(e, e, "vec_id", "vec_id", "embedding", 64, 5, exclude_self=True)
    labels = e.select(F.col("vec_id").alias("neighbor_id"), F.col("label").cast("string").alias("concept_id"))
    named = near.join(labels, "neighbor_id").select(
        F.concat(F.lit("v"), F.col("query_id").cast("string")).alias("name"), "concept_id", F.lit("t").alias("text"), F.lit("en").alias("language"), "score")
    return round_all(semantic.decide_by_similarity(named, 0.5, 0.05).select("name", "concept_id", "reason", "margin"), 5)


def _index(spark, sf):
    """Index rows with planted faults: a short vector, a repeated text, a missing list."""
    v = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("alias "), (v % 400).cast("string")).alias("text"), F.when(v % 90 != 1, F.array(F.col("label").cast("string"))).alias("concepts"),
        F.array(F.lit("en")).alias("languages"), F.array(F.lit("alias")).alias("sources"),
        F.when(v % 70 == 3, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")).alias("embedding"))


@query("c5_index_problems", """
WITH i AS (SELECT vec_id, 'alias ' || (vec_id % 400) AS text FROM embeddings)
SELECT 'missing_field' AS "check", text, NULL AS detail FROM i WHERE vec_id % 90 = 1 UNION ALL SELECT 'dimension', text, '10' FROM i WHERE vec_id % 70 = 3 UNION ALL
SELECT 'duplicate_text', text, count(*)::VARCHAR FROM i GROUP BY text HAVING count(*) > 1 UNION ALL SELECT 'declared_count', NULL, count(*)::VARCHAR FROM i HAVING count(*) <> 7""")
def c5(spark, sf):
    return semantic.validate_index(_index(spark, sf), 64, 7)


S4_SQL = "SELECT 'alias ' || vec_id AS text, label::VARCHAR AS concept_id, {language} AS language, len(embedding) AS dim, round(embedding[1]::DOUBLE, 5) AS first FROM embeddings"


def _index_texts(spark, sf, layout):
    text = F.concat(F.lit("alias "), F.col("vec_id").cast("string"))
    label = F.col("label").cast("string")
    vector = F.col("embedding").cast("array<double>")
    record = F.struct(text.alias("text"), label.alias("concept_id"), F.lit("en").alias("language"), vector.alias("embedding"))
    rows = table(spark, sf, "embeddings").withColumn("document", F.col("vec_id") % 16)  # documents of many records
    if layout == "nested":
        rows = rows.groupBy("document", label.alias("label")).agg(F.map_from_entries(F.collect_list(F.struct(text, vector))).alias("vectors"))
        shape = F.map_from_entries(F.collect_list(F.struct("label", "vectors")))
    else:
        records = F.collect_list(record)
        shape = {"records": records, "wrapper": F.struct(F.first(F.lit("x")).alias("model"), records.alias("embeddings")),
                 "mapping": F.map_from_entries(F.collect_list(F.struct(text, vector)))}[layout]
    return rows.groupBy("document").agg(F.to_json(shape).alias("json")).select("json")


def _read_index(spark, sf, layout):
    found = ontology.index_from_text(_index_texts(spark, sf, layout), layout)
    return round_all(found.select("text", "concept_id", "language", F.size("embedding").cast("long").alias("dim"), F.get("embedding", F.lit(0)).alias("first")), 5)


@query("s4_index_records", S4_SQL.format(language="'en'"))
def s4r(spark, sf):
    return _read_index(spark, sf, "records")


@query("s4_index_wrapper", S4_SQL.format(language="'en'"))
def s4w(spark, sf):
    return _read_index(spark, sf, "wrapper")


@query("s4_index_nested", S4_SQL.format(language="NULL"))
def s4n(spark, sf):
    return _read_index(spark, sf, "nested")


@query("s4_index_mapping", S4_SQL.format(language="'en'"))
def s4m(spark, sf):
    """Texts without a concept take the one concept they are an alias of."""
    found = ontology.index_from_text(_index_texts(spark, sf, "mapping"), "mapping")
    e = table(spark, sf, "embeddings")
    aliases = e.select(F.col("label").cast("string").alias("concept_id"), F.lit("en").alias("language"),
                       F.concat(F.lit("Alias_"), F.col("vec_id").cast("string"), F.lit("_7")).alias("text"), F.col("vec_id").alias("position"))
    keyed = found.withColumn("text", F.concat("text", F.lit(" 7")))
    out = ontology.resolve_concepts(keyed, aliases.withColumn("text", F.concat("text", F.lit("x"))).withColumn("text", F.regexp_replace("text", "x$", "")))
    return round_all(out.select(F.regexp_replace("text", " 7$", "").alias("text"), "concept_id", "language", F.size("embedding").cast("long").alias("dim"),
                                F.get("embedding", F.lit(0)).alias("first")), 5)


@query("c1_profile", with_(ORDERS) + """
SELECT 'price' AS name, true AS numeric, count(price) AS non_null, count(DISTINCT price) AS "unique", count(*) - count(price) AS missing, min(price) AS min_value, max(price) AS max_value FROM ord UNION ALL
SELECT 'prio', false, count(prio), count(DISTINCT prio), count(*) - count(prio), NULL, NULL FROM ord UNION ALL
SELECT 'odate', false, count(odate), count(DISTINCT odate), count(*) - count(odate), NULL, NULL FROM ord""")
def c1(spark, sf):
    found = profile.profile_columns(orders(spark, sf), "row_id", ["price", "prio", "odate"])
    return found.select("name", "numeric", "non_null", "unique", "missing", "min_value", "max_value")


@query("c4_encoded_texts")
def c4(spark, sf):
    return semantic.hashed_ngram_encoder(3, 64)(table(spark, sf, "pages").select("page_id", F.col("url").alias("text"))).select("page_id", "embedding")


@query("c10_inferred_semantics")
def c10(spark, sf):
    concepts, aliases = _ontology(spark, sf)
    encode = semantic.hashed_ngram_encoder(3, 64)
    built = semantic.build_index(aliases, encode)
    index = built.select("text", F.explode("concepts").alias("concept_id"), F.get("languages", F.lit(0)).alias("language"), "embedding")
    found = semantic.infer_semantics(_profiles(spark, sf), concepts, aliases, index, encode)
    return found.select("name", "concept_id", "status", "method", "reason", "confidence", "category")


@query("j11_attach_concepts", with_(ONTOLOGY, COLUMNS) + """
SELECT name, CASE WHEN split_part(norm, ' ', 1) IN (SELECT concept_id FROM co) THEN split_part(norm, ' ', 1) ELSE 'UNKNOWN' END AS concept_id,
  CASE WHEN split_part(norm, ' ', 1) IN (SELECT concept_id FROM co) THEN 'piece' END AS unit FROM nm""")
def j11(spark, sf):
    concepts, _ = _ontology(spark, sf)
    matches = _profiles(spark, sf).select("name", F.split("normalized_name", " ")[0].alias("concept_id"), F.lit("KNOWN").alias("status"),
                                          F.lit("given").alias("reason"), F.lit(1.0).alias("confidence"))
    return semantic.attach_concepts(matches, concepts).select("name", "concept_id", "unit")
