"""Queries of the retrieval pipeline, graph walks, claims and table upkeep over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gristmill.functions import normalize as N, text as X
from gristmill.functions.keys import clean_key
from gristmill.operators import documents as D, graph as G, orphans, records as R, search as S
from gristmill.plans import problems, reference as P
from gristmill.scratch import scratch_dir, staged, table
from gristmill.sources import readers
from gristmill.streaming import orphans as stream_orphans, tables as stream_tables


def _code(c: str):
    return clean_key(F.col(c))


def structured_lane(spark, sf_dir):
    """What the structured lane gives each question: 0.9 for the document whose key it names, 0.8 for those that refer to the key, the best of both."""
    asked, docs = P._queries(spark, sf_dir), table(spark, sf_dir, "documents")
    codes = asked.select("query_id", F.explode(X.identifiers(F.col("text"))).alias("code"))
    by_key = codes.join(docs.select("doc_id", _code("doc_code").alias("code")), "code").select("query_id", "doc_id", F.lit(0.9).alias("score"))
    naming = codes.join(docs.select("doc_id", _code("subject_id").alias("code")), "code").select("query_id", "doc_id", F.lit(0.8).alias("score"))
    return S.best_branch([by_key, naming])


def retrieve_evidence(spark, sf_dir):
    """The whole pipeline for each question: lanes, fusion, rerank by overlap, the words lane's first three as a floor, and the share of content terms covered."""
    asked, of = P._queries(spark, sf_dir), P._index(spark, sf_dir)
    words, structured, linked = P._lanes(spark, sf_dir, of)
    words = staged(words.select("query_id", "doc_id", "rank"), "words")
    fused = S.top_k(S.fuse([("hybrid", 1, words), ("structured", 3, structured), ("graph", 2, linked)]), 2 * P.K)
    reranked = S.top_k(S.overlaps(of, asked, fused), P.K)
    kept = staged(S.floor_union(words, reranked, 3, P.K), "kept")
    terms = asked.select("query_id", X.content_terms(F.col("text")).alias("terms"))
    covered = S.coverage_of(kept, terms, P._documents(spark, sf_dir)).select("query_id", "covered")
    return kept.join(covered, "query_id", "left").select("query_id", "doc_id", "rank", "lane", "covered")


def query_aliases(spark, sf_dir):
    """What each question names: identifiers first, then codenames of machines and lines, the longest first."""
    m = table(spark, sf_dir, "machines")
    names = m.select(F.lower(F.trim("codename")).alias("alias"), _code("machine_id").alias("id")).unionByName(
        m.select(F.lower(F.trim("line_codename")).alias("alias"), F.col("line").alias("id"))).filter("alias <> '' and id is not null").distinct()
    return D.longest_aliases(P._queries(spark, sf_dir), names, "query_id", "text")


def graph_scores(spark, sf_dir):
    """Nodes by the score of their distance from the regions."""
    seeds = table(spark, sf_dir, "region").select(F.concat(F.lit("R:"), F.col("r_regionkey").cast("string")).alias("seed"))
    scores = G.walk_scores(G.reach(P._trade_graph(spark, sf_dir), seeds, 3))
    return scores.groupBy(F.substring("id", 1, 1).alias("kind"), F.round("score", 6).alias("score")).agg(F.count("*").alias("n_nodes"))


def path_to_kind(spark, sf_dir):
    """From each program of the plant the shortest way to the first line."""
    edges = P._plant_graph(spark, sf_dir)
    starts = edges.filter("rel = 'RUNS_PROGRAM'").select(F.col("dst").alias("src")).distinct()
    return G.first_meeting(edges.filter("rel <> 'USED_ON'"), starts, edges.filter("rel = 'ON_LINE'").select(F.col("dst").alias("id")), 3)


def path_by_waypoint(spark, sf_dir):
    """Ways from the suppliers divisible by 100 (and 1) through their nation to each region they reach."""
    s = table(spark, sf_dir, "supplier").filter("s_suppkey % 100 = 0 or s_suppkey = 1")
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    nation = table(spark, sf_dir, "nation")
    routes = s.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        node("S:", "s_suppkey").alias("src"), node("N:", "n_nationkey").alias("via"), node("R:", "n_regionkey").alias("dst"))
    return G.path_through(P._trade_graph(spark, sf_dir), routes, 2)


def hop_check(spark, sf_dir):
    """Claimed hops of the orders, part to machine to program, against the plant's edges; a chain holds if both hops do."""
    edges = staged(P._plant_graph(spark, sf_dir), "plant")
    parts = table(spark, sf_dir, "purchase_orders").distinct().select("po", _code("part").alias("part")).filter(F.col("part").rlike("^PRT-[0-9]+$"))
    used = edges.filter("rel = 'USED_ON'").groupBy(F.col("src").alias("part")).agg(F.min("dst").alias("machine"))
    runs = edges.filter("rel = 'RUNS_PROGRAM'").groupBy(F.col("src").alias("machine")).agg(F.min("dst").alias("program"))
    chains = parts.groupBy("part").agg(F.count("*").alias("n")).join(used, "part", "left").join(runs, "machine", "left")
    one = G.verified_hops(chains.select(F.col("part").alias("src"), F.col("machine").alias("dst"), "n", "program"), edges)
    one = one.select(F.col("program").alias("src"), F.col("dst"), "n", F.col("verified").alias("first"))
    both = G.verified_hops(one, edges).select("n", "first", F.col("verified").alias("second"))
    return both.groupBy("first", "second", (F.col("first") & F.col("second")).alias("holds")).agg(F.sum("n").alias("n_orders"))


def waypoint_parts(spark, sf_dir):
    """For each kind of part (the last word of a description) the first part whose description holds it."""
    bom = table(spark, sf_dir, "bom_parts").filter("description is not null").select(_code("part_id").alias("part"), F.lower("description").alias("text"))
    words = bom.select("part", F.explode(F.array_distinct(F.split("text", r"[^a-z]+"))).alias("noun"))
    nouns = bom.select(F.regexp_extract("text", r"([a-z]+)$", 1).alias("noun")).filter("noun <> ''").distinct()
    return words.join(nouns, "noun").groupBy("noun").agg(F.min("part").alias("part"), F.countDistinct("part").alias("n_parts"))


def line_neighbours(spark, sf_dir):
    """The machines of each line in order."""
    edges = P._plant_graph(spark, sf_dir).filter("rel = 'ON_LINE'")
    lines = G.neighbors(edges, edges.select(F.col("dst").alias("id")))
    return lines.groupBy(F.col("src").alias("line")).agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("machines"))


def merged_machines(spark, sf_dir):
    """One node for each machine with all its codenames and programs, one edge for each pair, by the first row."""
    m = table(spark, sf_dir, "machines")
    listed = lambda c: F.array_compact(F.array(c))
    nodes = G.merge_nodes(m.select(_code("machine_id").alias("id"), listed(F.lower(F.trim("codename"))).alias("aliases"), listed("program").alias("sources")))
    edges = m.filter("line is not null").select(_code("machine_id").alias("src"), F.lit("ON_LINE").alias("rel"), F.col("line").alias("dst"), "loaded_at")
    first = G.merge_edges(edges, "loaded_at").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_lines"))
    return nodes.join(first, "id", "left").select("id", F.array_join("aliases", ";").alias("aliases"), F.array_join("sources", ";").alias("programs"), "n_lines")


def backfill_edges(spark, sf_dir):
    """Edges that the rows of all tables state, by table and relation, the identity column found by its name."""
    found = None
    for name in ("bom_parts", "machines", "cmms_export", "purchase_orders", "suppliers_master"):
        edges = G.edges_of_table(table(spark, sf_dir, name).distinct()).groupBy("rel").agg(F.count("*").alias("n_edges"), F.countDistinct("src").alias("n_subjects"))
        edges = edges.withColumn("table_name", F.lit(name))
        found = edges if found is None else found.unionByName(edges)
    return found


def grounded_relations(spark, sf_dir):
    """Of each document's key and subject, those that its text holds, and the relations between them that this leaves."""
    docs = table(spark, sf_dir, "documents")
    entities = docs.select("doc_id", F.explode(F.array_compact(F.array("doc_code", "subject_id"))).alias("entity"))
    kept, related = G.grounded(entities, docs.select("doc_id", F.col("doc_code").alias("src"), F.col("subject_id").alias("dst")), docs)
    n = kept.groupBy("doc_id").agg(F.count("*").alias("e")).join(related.groupBy("doc_id").agg(F.count("*").alias("r")), "doc_id", "left")
    return docs.join(n, "doc_id", "left").groupBy("doc_type").agg(F.sum(F.coalesce("e", F.lit(0))).alias("n_entities"), F.sum(F.coalesce("r", F.lit(0))).alias("n_relations"))


def remove_documents(spark, sf_dir):
    """Mentions and edges that are left once the deleted documents are taken out."""
    docs = table(spark, sf_dir, "documents")
    units = staged(D.mentions(docs), "units")
    edges = units.join(docs.select("doc_id", F.col("doc_code").alias("src")), "doc_id").select("src", F.lit("MENTIONS").alias("rel"), F.col("code").alias("dst")).distinct()
    left, kept = D.removed(docs.filter("deleted_at is not null"), units, edges)
    of = lambda df, name: df.agg(F.count("*").alias("n_left")).select(F.lit(name).alias("kind"), "n_left")
    return of(left, "units").unionByName(of(kept, "edges"))


def live_documents(spark, sf_dir):
    """Chunks and identifiers of each document that was not deleted."""
    docs = table(spark, sf_dir, "documents").filter("deleted_at is null")
    units = D.chunks(docs).select("doc_id", F.lit("chunk").alias("kind")).unionByName(D.mentions(docs).select("doc_id", F.lit("code").alias("kind")))
    return units.groupBy("doc_id").agg(F.count_if(F.col("kind") == "chunk").alias("n_chunks"), F.count("*").alias("n_units"))


def load_gate(spark, sf_dir):
    """What must hold before the index is served: vectors for the documents, one width, no key used twice, few dangling mentions."""
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    with_vector = docs.select("doc_id").join(vectors.select(F.col("vec_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    covered = docs.agg(F.count("*").alias("n")).join(F.broadcast(with_vector.agg(F.count("*").alias("m")))).select((F.col("m") / F.col("n")).alias("value"))
    edges = D.mentions(docs).select(F.col("doc_id").cast("string").alias("src"), F.lit("MENTIONS").alias("rel"), F.col("code").alias("dst"))
    nodes = docs.select(_code("doc_code").alias("id")).unionByName(docs.select(F.col("doc_id").cast("string").alias("id")))
    lost = G.dangling(edges, nodes).agg(F.count("*").cast("double").alias("value"))
    widths = vectors.agg(F.countDistinct(F.size("embedding")).cast("double").alias("value"))
    twice = docs.groupBy("doc_code").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).cast("double").alias("value"))
    out = None
    for name, df, holds in (("coverage", covered, F.col("value") >= 1.0), ("widths", widths, F.col("value") == 1.0), ("keys_twice", twice, F.col("value") == 0.0), ("dangling", lost, F.col("value") == 0.0)):
        row = df.select(F.lit(name).alias("check"), F.round("value", 6).alias("value"), holds.alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out


def keys_across_tables(spark, sf_dir):
    """Where the identifiers that questions name are keys of rows."""
    codes = P._queries(spark, sf_dir).select(F.explode(X.identifiers(F.col("text"))).alias("key"))
    keys = {"bom_parts": "part_id", "machines": "machine_id", "suppliers_master": "supplier_id", "purchase_orders": "po", "cmms_export": "wo", "documents": "doc_code"}
    return R.across({name: table(spark, sf_dir, name) for name in keys}, keys, codes)


def suppliers_us(spark, sf_dir):
    return R.in_country(table(spark, sf_dir, "suppliers_master"), "country").select(_code("supplier_id").alias("supplier_id")).distinct()


def rows_naming_machines(spark, sf_dir):
    """Work orders and parts that name a machine in any of their fields, by machine."""
    machines = table(spark, sf_dir, "machines").select(_code("machine_id").alias("ref"))
    found = None
    for name in ("cmms_export", "bom_parts"):
        part = R.naming(table(spark, sf_dir, name).distinct(), machines).groupBy("ref").agg(F.count("*").alias("n_rows")).withColumn("table_name", F.lit(name))
        found = part if found is None else found.unionByName(part)
    return found


def list_references(spark, sf_dir):
    """Documents by how many questions and manifest files name them in their lists."""
    docs = table(spark, sf_dir, "documents").select(_code("doc_code").alias("ref"))
    q = table(spark, sf_dir, "questions").distinct().select("gold_doc_ids")
    m = table(spark, sf_dir, "ingestion_manifest").distinct().select("maps_to_doc_ids")
    found = R.naming(q, docs).select("ref").unionByName(R.naming(m, docs).select("ref"))
    return found.groupBy("ref").agg(F.count("*").alias("n_rows"))


def spaced_durations(spark, sf_dir):
    """Durations with blanks between numbers and units."""
    rows = table(spark, sf_dir, "cmms_export").distinct()
    return rows.groupBy(X.space_units(F.trim("downtime")).alias("spaced")).agg(F.count("*").alias("n_rows"))


def document_names(spark, sf_dir):
    """Capitalised phrases that open documents, by how many name them."""
    names = P._documents(spark, sf_dir).select("doc_id", F.explode(X.name_phrases(F.col("text"))).alias("phrase"))
    return names.groupBy("phrase").agg(F.count("*").alias("n_documents"))


def metric_means(spark, sf_dir):
    """Means of the metrics over the values that are numbers, null and NaN aside."""
    rows = table(spark, sf_dir, "oee_daily").distinct()
    value = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double")).cast("decimal(18,6)")
    return rows.groupBy("machine").agg(*[F.round(F.avg(value(c)).cast("double"), 4).alias(c) for c in ("availability", "performance", "quality")])


def significant_facts(spark, sf_dir):
    """Facts that a mapped document holds: all their identifiers and numbers, or without any 60 % of their words."""
    facts = table(spark, sf_dir, "ingestion_manifest").select("source_file", "maps_to_doc_ids", F.explode("key_facts").alias("fact")).distinct()
    hard = F.array_union(F.transform(X.identifiers(F.col("fact")), F.lower), F.regexp_extract_all("fact", F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))
    soft = X.content_terms(F.col("fact"))
    wanted = facts.select("source_file", "fact", F.when(F.size(hard) > 0, hard).otherwise(soft).alias("terms"), F.when(F.size(hard) > 0, 1.0).otherwise(0.6).alias("share"),
                          F.explode_outer("maps_to_doc_ids").alias("code")).withColumn("code", _code("code"))
    found = wanted.join(table(spark, sf_dir, "documents").select(_code("doc_code").alias("code"), "text"), "code", "left")
    present = F.size(F.filter("terms", lambda t: F.coalesce(S.has_term(F.col("text"), t), F.lit(False))))
    per = found.groupBy("source_file", "fact").agg(F.max((F.size("terms") > 0) & (present >= F.col("share") * F.size("terms"))).alias("hit"))
    return per.groupBy("source_file").agg(F.count("*").alias("n_facts"), F.count_if("hit").alias("n_recovered"))


def claim_kinds(spark, sf_dir):
    """Claims by kind, verified or not: answers word for word in a gold document, all cited documents there, codes that no document mentions."""
    q = table(spark, sf_dir, "questions").distinct().select("qid", "question", "gold_doc_ids", "reference_answer")
    docs = table(spark, sf_dir, "documents").select(_code("doc_code").alias("code"), "text", "doc_id")
    cited = q.select("qid", "reference_answer", F.explode("gold_doc_ids").alias("code")).withColumn("code", _code("code")).filter("code <> ''")
    stands = F.coalesce(F.contains(F.lower("text"), F.lower(F.regexp_replace(F.trim("reference_answer"), r"[.\s]+$", ""))), F.lit(False))
    verbatim = cited.filter("trim(reference_answer) <> ''").join(docs, "code", "left").groupBy("qid").agg(F.max(stands).alias("verified"))
    complete = R.verify_sets(cited, cited.join(docs.select("code").distinct(), "code", "left_semi"), "qid", "code")
    codes = q.select("qid", F.explode(X.identifiers(F.col("question"))).alias("code")).distinct()
    known = staged(D.mentions(docs.select("doc_id", "text")).select("code").distinct(), "known")
    absent = codes.join(known.withColumn("k", F.lit(True)), "code", "left").groupBy("qid").agg((F.count("k") == 0).alias("verified"))
    out = None
    for kind, df in (("verbatim", verbatim), ("complete", complete), ("absent", absent)):
        part = df.groupBy("verified").agg(F.count("*").alias("n_claims")).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


def conflict_questions(spark, sf_dir):
    """Questions that name a part whose orders disagree, and those of them that ask about orders."""
    parts = P.conflict_resolution(spark, sf_dir).select(F.col("part").alias("code"), "chosen")
    q = table(spark, sf_dir, "questions").distinct().filter("question is not null")
    codes = q.select("qid", "category", F.col("question").alias("text"), F.explode(X.identifiers(F.upper("question"))).alias("code"))
    topical = F.lower("text").rlike(r"\b(?:order|orders|quantity|moq|minimum|price|cost|lead)\b")
    return codes.join(parts, "code").groupBy("category").agg(F.count("*").alias("n_named"), F.count_if(topical).alias("n_topical"))


def grounding_gate(spark, sf_dir):
    """Answers withheld because three values or more and over 40 % of them stand in no gold document."""
    q = table(spark, sf_dir, "questions").distinct().select("qid", "gold_doc_ids", "reference_answer")
    each = q.select("qid", F.explode(F.array_distinct(F.regexp_extract_all("reference_answer", F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))).alias("number"), F.col("gold_doc_ids"))
    each = each.select("qid", "number", F.explode_outer("gold_doc_ids").alias("code")).withColumn("code", _code("code"))
    docs = table(spark, sf_dir, "documents").select(_code("doc_code").alias("code"), "text")
    seen = each.join(docs, "code", "left").groupBy("qid", "number").agg(F.max(F.coalesce(S.has_term(F.col("text"), F.col("number")), F.lit(False))).alias("seen"))
    per = seen.groupBy("qid").agg(F.count("*").alias("n"), F.count_if(~F.col("seen")).alias("lost"))
    return per.groupBy("n", "lost", ((F.col("lost") >= 3) & (F.col("lost") > 0.4 * F.col("n"))).alias("withheld")).agg(F.count("*").alias("n_answers"))


def mixed_conversions(spark, sf_dir):
    """Sizes and lead times in other units, each by the factor of its own pair of units."""
    part = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("value"), F.lit("mm").alias("from_unit"), F.lit("in").alias("to_unit"))
    lead = table(spark, sf_dir, "purchase_orders").distinct().select(F.regexp_extract(F.lower("lead_time"), r"^(\d+)\s*weeks?$", 1).try_cast("double").alias("value"), F.lit("wk").alias("from_unit"), F.lit("d").alias("to_unit"))
    both = part.unionByName(lead.filter("value is not null")).join(F.broadcast(N.factors(spark)), ["from_unit", "to_unit"])
    return both.groupBy("from_unit", "to_unit", F.round(F.col("value") * F.col("factor"), 4).alias("result")).agg(F.count("*").alias("n"))


def csv_round_trip(spark, sf_dir):
    """The supplier table written as CSV and read again."""
    home = f"{scratch_dir(spark)}/csv-{uuid.uuid4().hex}"
    s = table(spark, sf_dir, "suppliers_master").distinct().select(F.trim("supplier_id").alias("supplier_id"), F.trim("supplier_name").alias("supplier_name"), F.trim("products").alias("products"))
    readers.write_csv(s.filter("supplier_name <> '' and products <> ''"), home)
    return readers.read_csv(spark, home).groupBy("supplier_id").agg(F.count("*").alias("n_rows"), F.countDistinct("supplier_name", "products").alias("n_typings"))


def json_lines_round_trip(spark, sf_dir):
    """The manifest written as JSON lines and read again, every line whole."""
    home = f"{scratch_dir(spark)}/json-{uuid.uuid4().hex}"
    m = table(spark, sf_dir, "ingestion_manifest").distinct().select("source_file", "file_format", "maps_to_doc_ids", "notes")
    readers.write_json_lines(m, home)
    back = readers.read_json_lines(spark, home, m.schema, strict=True)
    return back.groupBy("file_format").agg(F.count("*").alias("n_files"), F.sum(F.size("maps_to_doc_ids")).alias("n_codes"), F.count("notes").alias("n_notes"))


def record_upsert(spark, sf_dir):
    """Orders of the first half of the history brought up to date with those of the second, by part."""
    po = table(spark, sf_dir, "purchase_orders").distinct().select(_code("part").alias("part"), "po", "loaded_at").filter(F.col("part").rlike("^PRT-[0-9]+$"))
    late = F.col("loaded_at") >= F.lit("2025-04-01").cast("timestamp_ntz")
    last = lambda df: df.groupBy("part").agg(F.max(F.struct("loaded_at", "po")).alias("m")).select("part", "m.po", "m.loaded_at")
    return R.upsert(last(po.filter(~late)), last(po.filter(late)), ["part"], "loaded_at").select("part", "po")


def event_stream_windows(spark, sf_dir):
    """Events counted in tumbling days as a stream, each window once it is closed by the watermark."""
    batch = table(spark, sf_dir, "events")
    home = f"{scratch_dir(spark)}/windows-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/events.parquet*")
    counted = stream_tables.windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 day", "1 hour")
    stream_tables.finished(counted, f"{home}/table", f"{home}/checkpoint")
    return spark.read.schema("start timestamp, event_type string, n bigint, total double").parquet(f"{home}/table").select(F.col("start").cast("timestamp_ntz").alias("day"), "event_type", F.col("n").alias("n_events"))


def orphan_stream(spark, sf_dir):
    """Orphan references as a stream of the kept state: references and parents arrive as written events, a file a quarter, in no order within it."""
    refs = problems.references(spark, sf_dir).distinct().filter("ts is not null").select("target", "key", F.col("ts").cast("timestamp_ntz").alias("ts"), F.lit("ref").alias("kind"), "ref_table", F.col("row_key").alias("ref_id"))
    moves = orphans.parent_moves(problems.targets(spark, sf_dir))
    each = moves.select("target", "key", "ts", F.when(F.col("delta") > 0, "parent").otherwise("deleted").alias("kind"), F.explode(F.sequence(F.lit(1), F.abs("delta"))))
    events = refs.unionByName(each.drop("col").withColumn("ref_table", F.lit(None).cast("string")).withColumn("ref_id", F.lit(None).cast("string")))
    home = f"{scratch_dir(spark)}/orphans-{uuid.uuid4().hex}"
    for n, (lo, hi) in enumerate((("1900-01-01", "2025-02-01"), ("2025-02-01", "2025-05-01"), ("2025-05-01", "2999-01-01"))):
        events.filter((F.col("ts") >= F.lit(lo).cast("timestamp_ntz")) & (F.col("ts") < F.lit(hi).cast("timestamp_ntz"))).write.parquet(f"{home}/in/part={n}")
        stream = spark.readStream.schema(events.schema).parquet(f"{home}/in/part=*")
        stream_tables.done(stream_orphans.track(stream, f"{home}/state"))
    found = stream_orphans.opened(spark, f"{home}/state")
    return found.groupBy("ref_table", F.date_format("ts", "yyyy-MM").alias("ref_month")).agg(F.countDistinct("ref_id", "key").alias("n_orphans"))


QUERIES = {
    f.__name__: f
    for f in (
        structured_lane, retrieve_evidence, query_aliases, graph_scores, path_to_kind, path_by_waypoint, hop_check, waypoint_parts, line_neighbours, merged_machines,
        backfill_edges, grounded_relations, remove_documents, live_documents, load_gate, keys_across_tables, suppliers_us, rows_naming_machines, list_references,
        spaced_durations, document_names, metric_means, significant_facts, claim_kinds, conflict_questions, grounding_gate, mixed_conversions, csv_round_trip,
        json_lines_round_trip, record_upsert, event_stream_windows, orphan_stream,
    )
}

