"""Every query by name; each takes a session and a table folder and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.sqltext import unveil
from millrace.operators import graph
from millrace.operators.staging import new_path, stage
from millrace.plans import (
    catalog, corpus_graph, customers, dbt, impact, lineage, loading, models, patterns, revenue, sales, shapes, statement_graph, trace,
)
from millrace.plans.warehouse import raw_accounts, raw_orders
from millrace.sources import corpus
from millrace.sources.parsed import ParsedScripts
from millrace.sources.tables import scripts_from_directory, write_graph_json, write_script_files
from millrace.streaming.incremental import stream_events

Query = Callable[[SparkSession, str], DataFrame]


def _business() -> dict[str, Query]:
    def flow(name: str) -> Query:
        return lambda spark, folder: customers.shown(customers.customer_flow(spark, folder)[name])

    return {
        "customer_txn": flow("staging.customer_txn"),
        "customer_summary": flow("mart.customer_summary"),
        "high_value_customers": flow("mart.high_value_customers"),
        "stg_orders": lambda s, d: customers.shown(loading.stg_orders_window(s, d)),
        "stg_customers": lambda s, d: sales.stg_customers(raw_accounts(s, d)),
        "sales_daily": lambda s, d: sales.sales_daily(*loading.staged(s, d)),
        "sales_daily_one_day": loading.sales_daily_for,
        "customer_ltv": lambda s, d: sales.customer_ltv(
            sales.stg_customers(raw_accounts(s, d)), sales.stg_orders(raw_orders(s, d))
        ),
        "upsert_sales_daily": loading.upsert_sales_daily,
        "upsert_customer_ltv": loading.upsert_customer_ltv,
        "upsert_partitioned": loading.upsert_partitioned,
        "merge_balances": loading.merge_balances,
        "incremental_events": loading.incremental_events,
        "replace_vs_insert": loading.replace_vs_insert,
        "truncate_load_orders": loading.truncate_load_orders,
        "insert_values": loading.insert_region,
        "row_count_gate": loading.row_count_gate,
        "materialization_policies": loading.stored_policies,
        "monthly_revenue": revenue.monthly_revenue,
        "all_events_union": shapes.all_events,
        "rank_customers": shapes.rank_customers,
        "rank_in_segment": shapes.rank_in_segment,
        "row_number_orders": shapes.row_number_orders,
        "running_total": shapes.running_total,
        "segment_share": shapes.segment_share,
        "agg_family": shapes.agg_family,
        "pivot_status": shapes.pivot_status,
        "unpivot_measures": shapes.unpivot_measures,
        "cross_apply_top_orders": shapes.cross_apply_top_orders,
        "outer_apply_top_order": shapes.outer_apply_top_order,
        "lateral_totals": shapes.lateral_totals,
        "listagg_lines": shapes.listagg_lines,
        "nested_subquery": shapes.nested_subquery,
        "scalar_subquery_filter": shapes.scalar_subquery_filter,
        "self_join_managers": shapes.self_join_managers,
        "hierarchy_levels": shapes.hierarchy_levels,
        "recursive_reports": shapes.recursive_reports,
        "hierarchy_marks": shapes.hierarchy_marks,
        "gross_margin": shapes.gross_margin,
    }


def flat(df: DataFrame) -> DataFrame:
    """Lists as comma-joined text and small integers as long ones, for comparison with other engines."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind == "array":
            out.append(F.array_join(F.col(f.name).cast("array<string>"), ",").alias(f.name))
        elif kind == "integer":
            out.append(F.col(f.name).cast("bigint").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def _statements(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.statements(corpus.scripts(spark, folder))


def _slim(spark: SparkSession, folder: str) -> DataFrame:
    """The catalogue with the head of each text only, written once for the jobs that read it several times."""
    return stage(
        _statements(spark, folder).select(
            "script_id", "stmt_no", "label", "target_table", "source_tables",
            F.substring("raw_sql", 1, lineage.TASK_SNIPPET).alias("raw_sql"),
        ),
        "statements",
    )


def _models(spark: SparkSession, folder: str) -> DataFrame:
    return models.models(_statements(spark, folder))


def _digest(spark: SparkSession, folder: str) -> DataFrame:
    return stage(impact.digest(_models(spark, folder)), "digest")


def _graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Column index and model edges."""
    digest = _digest(spark, folder)
    return stage(impact.column_index(digest), "columns"), stage(impact.model_edges(digest), "edges")


def _questions(columns: DataFrame) -> DataFrame:
    """Every projected column of each script, and one that no script has."""
    asked = F.explode(F.array("column", F.lit("no_such_column")))
    return columns.where("column <> '*'").select("script_id", asked.alias("column")).distinct()


def _statement_queries() -> dict[str, Query]:
    def stmt_catalog(s, d):
        return _statements(s, d).drop("veiled")

    def stmt_aggregations(s, d):
        used = _statements(s, d).select("script_id", "stmt_no", F.explode("aggregations").alias("aggregation"))
        return used.groupBy("aggregation").agg(
            F.count(F.lit(1)).alias("statements"), F.count_distinct("script_id").alias("scripts")
        )

    def levels(s, d):
        statements = _slim(s, d)
        return statement_graph.levels(statements, statement_graph.edges(statements))

    def dependency_labels(s, d):
        statements = _slim(s, d)
        edges = stage(statement_graph.edges(statements), "edges")
        return statement_graph.dependency_labels(statements, edges, statement_graph.levels(statements, edges))

    def script_directory(s, d):
        """The corpus as files, one folder for each of seven groups, read back and split into statements."""
        path = new_path(s, "scripts")
        place, name = F.concat(F.lit("group_"), F.col("script_id") % 7), F.concat(F.lit("script_"), F.col("script_id"))
        write_script_files(corpus.scripts(s, d).select(place.alias("place"), name.alias("name"), "sql_text"), path)
        files = scripts_from_directory(s, path).withColumnRenamed("name", "script_id")
        counts = catalog.statements(files).groupBy("script_id").agg(F.count(F.lit(1)).alias("statements"))
        place = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("place")
        # Before the join, which then moves no texts.
        facts = files.select("script_id", place, F.length("sql_text").alias("chars"), F.sha2("sql_text", 256).alias("checksum"))
        return facts.join(counts, "script_id", "left").select(
            F.col("script_id").alias("name"), "place", "chars", "checksum", F.coalesce("statements", F.lit(0)).alias("statements")
        )

    def catalog_refresh(s, d):
        """The catalogue of each script's second version after a run over the first: ``run`` 2 parsed what is new only."""
        versions = stage(corpus.script_versions(s, d), "versions")
        old, new = (versions.select("script_id", F.col(v).alias("sql_text")) for v in ("v1", "v2"))
        store = ParsedScripts(s, new_path(s, "parsed"))
        store.refresh(old)
        store.refresh(new)
        return store.statements(new).select("script_id", "stmt_no", "statement_type", "target_table", "raw_sql", "run")

    return {
        "script_directory": script_directory,
        "catalog_refresh": catalog_refresh,
        "corpus_edges": lambda s, d: corpus_graph.edges(_slim(s, d)),
        "corpus_downstream": lambda s, d: corpus_graph.downstream(
            used := stage(_statements(s, d).select("target_table", "source_tables"), "statements"),
            used.select(F.explode("source_tables").alias("table")).where("table LIKE 'raw.%'"),
        ),
        "script_clean": lambda s, d: catalog.normalised(corpus.scripts(s, d)),
        "rejected_scripts": lambda s, d: catalog.rejected(corpus.scripts(s, d)),
        "unsafe_labels": lambda s, d: catalog.rejected_labels(_statements(s, d)),
        "stmt_catalog": stmt_catalog,
        "stmt_aggregations": stmt_aggregations,
        "stmt_edges": lambda s, d: statement_graph.edges(_slim(s, d)),
        "stmt_edges_nearest_prior": lambda s, d: statement_graph.edges(_slim(s, d), "nearest_prior"),
        "stmt_predecessors": lambda s, d: statement_graph.predecessors(statement_graph.edges(_slim(s, d))),
        "stmt_levels": levels,
        "cycles": lambda s, d: statement_graph.cycles(statement_graph.edges(_slim(s, d))),
        "dependency_labels": dependency_labels,
        "tables_touched": lambda s, d: catalog.tables_touched(_statements(s, d)),
        "corpus_rollup": lambda s, d: catalog.type_rollup(_statements(s, d)),
        "most_read_tables": lambda s, d: catalog.most_read(_statements(s, d)),
        "script_changes": lambda s, d: catalog.snapshot_changes(
            corpus.script_versions(s, d).select("script_id", F.col("v1").alias("sql_text")),
            corpus.script_versions(s, d).select("script_id", F.col("v2").alias("sql_text")),
        ),
        "pattern_hits": lambda s, d: patterns.pattern_hits(corpus.scripts(s, d)).drop("line"),
        "nesting_depth": lambda s, d: patterns.nesting_depth(corpus.scripts(s, d)),
        "pattern_warnings": lambda s, d: patterns.warnings(corpus.scripts(s, d)),
        "script_complexity": lambda s, d: patterns.complexity(corpus.scripts(s, d)),
        "cte_order": lambda s, d: patterns.cte_order(corpus.scripts(s, d)),
    }


def _model_queries() -> dict[str, Query]:
    def cte_bodies(s, d):
        selects = _models(s, d).where("statement_type <> 'INSERT_VALUES'")
        return selects.select("script_id", "stmt_no", "ord", "is_final", "name", unveil(F.col("body")).alias("body"))

    def dbt_levels(s, d):
        parsed = stage(dbt.parse(corpus.dbt_models(s, d)), "dbt")
        nodes = parsed.select("project", F.col("name").alias("node"))
        return graph.levels(nodes, dbt.edges(parsed), ["project"]).withColumnRenamed("node", "name")

    def dbt_models(s, d):
        pair = lambda p: F.concat(p["schema"], F.lit("."), p["table"])
        return dbt.parse(corpus.dbt_models(s, d)).withColumn("sources", F.transform("sources", pair))

    return {
        "cte_bodies": cte_bodies,
        "model_columns": lambda s, d: models.model_columns(_models(s, d)).drop("item"),
        "column_counts": lambda s, d: models.column_counts(_models(s, d)),
        "model_catalog": lambda s, d: models.model_catalog(_models(s, d)),
        "model_refs": lambda s, d: models.model_refs(stage(_models(s, d), "models")),
        "source_catalog": lambda s, d: models.source_catalog(stage(_models(s, d), "models")),
        "dbt_models": dbt_models,
        "dbt_rejected": lambda s, d: dbt.rejected(corpus.dbt_models(s, d)),
        "dbt_edges": lambda s, d: dbt.edges(stage(dbt.parse(corpus.dbt_models(s, d)), "dbt")),
        "dbt_levels": dbt_levels,
    }


def _impact_queries() -> dict[str, Query]:
    def impact_all_columns(s, d):
        digest = _digest(s, d)
        index = stage(impact.column_index(digest), "columns")
        edges = stage(impact.model_edges(digest), "edges")
        return impact.impact(index, edges, impact.task_reads(impact.tasks(_slim(s, d)), digest))

    def model_closure(s, d):
        return graph.closure(_graph(s, d)[1], ["script_id"])

    def critical_path(s, d):
        digest = _digest(s, d)
        index = stage(impact.column_index(digest), "columns")
        edges = stage(impact.model_edges(digest), "edges")
        first = digest.groupBy("script_id", F.col("name").alias("model")).agg(
            F.min(F.struct("stmt_no", "ord")).alias("place")
        )
        return impact.critical_path(index, edges, first)

    def rename_impact(s, d):
        parsed = stage(_models(s, d), "models")
        index = stage(impact.column_index(impact.digest(parsed)), "columns")
        renames = index.select(
            "script_id", F.col("column").alias("old_value"), F.concat("column", F.lit("_v2")).alias("new_value")
        ).distinct()
        words, hints = impact.word_index(parsed)
        return impact.rename_impact(stage(words, "words"), stage(hints, "hints"), index, renames)

    def traced(s, d):
        parsed = stage(_models(s, d).drop("body"), "models")
        questions = stage(_questions(models.model_columns(parsed)), "questions")
        return trace.trace_steps(parsed, questions), questions

    def column_trace(s, d):
        return traced(s, d)[0].drop("is_final")

    def column_trace_across(s, d):
        parsed = stage(_models(s, d), "models")
        return trace.trace_across(parsed, _questions(models.model_columns(parsed)))

    def trace_rollup(s, d):
        steps, questions = traced(s, d)
        return trace.trace_rollup(steps, _statements(s, d), questions)

    return {
        "model_edges": lambda s, d: impact.model_edges(_digest(s, d)),
        "column_index": lambda s, d: impact.column_index(_digest(s, d)),
        "model_closure": model_closure,
        "impact_all_columns": impact_all_columns,
        "dependency_tree": lambda s, d: impact.dependency_tree(*_graph(s, d)),
        "critical_path": critical_path,
        "rename_impact": rename_impact,
        "breaking_changes": lambda s, d: impact.breaking_changes(corpus.script_versions(s, d)),
        "column_trace": column_trace,
        "column_trace_across": column_trace_across,
        "trace_rollup": trace_rollup,
    }


def _lineage_queries() -> dict[str, Query]:
    def inputs(s, d):
        return _digest(s, d), impact.tasks(_slim(s, d))

    def neighbours(s, d):
        digest, tasks = inputs(s, d)
        return lineage.neighbours(lineage.nodes(digest, tasks), lineage.edges(digest, tasks))

    def export(s, d):
        digest, tasks = inputs(s, d)
        node, edge = lineage.export(lineage.nodes(digest, tasks), lineage.edges(digest, tasks))
        path = new_path(s, "lineage-json")
        write_graph_json(node, edge, path)
        nodes = s.read.schema(node.schema).json(f"{path}/nodes").select(
            F.lit("node").alias("kind"), "script_id", F.col("id").alias("a"), F.col("label").alias("b")
        )
        edges = s.read.schema(edge.schema).json(f"{path}/edges").select(
            F.lit("edge").alias("kind"), "script_id", F.col("source").alias("a"), F.col("target").alias("b")
        )
        return nodes.unionByName(edges)

    return {
        "lineage_nodes": lambda s, d: lineage.nodes(*inputs(s, d)),
        "lineage_edges": lambda s, d: lineage.edges(*inputs(s, d)),
        "lineage_neighbours": neighbours,
        "lineage_export": export,
    }


def _flattened(entries: dict[str, Query]) -> dict[str, Query]:
    return {name: (lambda s, d, q=query: flat(q(s, d))) for name, query in entries.items()}


def queries() -> dict[str, Query]:
    return {
        **_business(),
        "incremental_events_stream": stream_events,
        **_flattened({**_statement_queries(), **_model_queries(), **_impact_queries(), **_lineage_queries()}),
    }
