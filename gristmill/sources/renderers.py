"""Markdown documents from small frames, and their files."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as X
from gristmill.sources.configs import Taxonomy
from gristmill.sources.sinks import markdown_table


def write_markdown(text: str, path: str) -> Path:
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text, encoding="utf-8")
    return target


def _joined(*parts: str) -> str:
    return "\n\n".join(p.strip("\n") for p in parts if p) + "\n"


def taxonomy_document(taxonomy: Taxonomy, coverage: DataFrame, problems: list[str]) -> str:
    """Categories with their targets and how much of the corpus mentions them.

    ``coverage`` has ``category, pct, top_terms`` and a row per category.
    """
    found = {r["category"]: r for r in coverage.collect()}  # one row per category
    rows = [f"| `{c.name}` | {c.description} | {c.target_count} | {c.negative_count} | {found[c.name]['pct']:.2f} % | {found[c.name]['top_terms']} |" for c in taxonomy.categories]
    share = 100 * taxonomy.total_negative / taxonomy.total_target if taxonomy.total_target else 0.0
    head = f"{taxonomy.total_target} questions (expected {taxonomy.expected_total}, give or take {taxonomy.total_tolerance}), of which {taxonomy.total_negative} negative ({share:.2f} %)."
    table = "| Category | Description | Target | Negative | Coverage | Top terms |\n|-|-|-:|-:|-:|-|\n" + "\n".join(rows)
    return _joined("# Taxonomy", head, table, "## Validation", "\n".join(f"- {p}" for p in problems) or "Passes all checks.")


def taxonomy_problems(taxonomy: Taxonomy, coverage: DataFrame) -> list[str]:
    """What is wrong with a taxonomy: its total, categories without negatives, categories that the corpus hardly mentions."""
    pct = {r["category"]: r["pct"] for r in coverage.collect()}  # one row per category
    out = [] if taxonomy.total_fits else [f"the targets add up to {taxonomy.total_target}, not {taxonomy.expected_total}"]
    for c in taxonomy.categories:
        if not c.negative_count:
            out.append(f"{c.name}: no negative questions")
        if pct.get(c.name, 0.0) < taxonomy.min_coverage_pct_hard_floor:
            out.append(f"{c.name}: the corpus doesn't cover it")
        elif pct[c.name] < taxonomy.min_coverage_pct:
            out.append(f"{c.name}: covered by {pct[c.name]:.2f} % of the corpus only")
    return out


def _sections(rows: DataFrame, title: str, note: str) -> str:
    """``rows`` has ``place`` and ``section``; there is one for each question of a benchmark."""
    return _joined(f"# {title}", note, *(r["section"] for r in rows.orderBy("place").collect()))


def relevance_worksheet(pools: DataFrame, snippets: DataFrame) -> str:
    """The pooled candidates of every question, for a reader to judge.

    ``pools`` has ``question_id, category, question, is_negative, doc_ids``, ``snippets``
    ``doc_id, text, rating, has_image``.
    """
    flag = F.when(F.coalesce("has_image", F.lit(False)), " [has image]").otherwise("")
    line = F.when(F.col("text").isNull(), F.concat(F.lit("- `"), F.col("id"), F.lit("`: (text not found)"))).otherwise(
        F.concat(F.lit("- `"), F.col("id"), F.lit("` ("), X.plain_number("rating"), F.lit("★"), flag, F.lit("): "), F.col("text"))
    )
    every = pools.select("question_id", F.posexplode_outer("doc_ids").alias("place", "id")).join(snippets.withColumn("doc_id", F.col("doc_id").cast("string")), F.col("id") == F.col("doc_id"), "left")
    listed = every.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("place", line.alias("line"))))), lambda x: x["line"]), "\n").alias("lines"))
    title = F.concat(F.lit("## "), F.col("question_id").cast("string"), F.lit(" ["), "category", F.lit("]"), F.when(F.col("is_negative"), " (negative: few or no relevant candidates expected)").otherwise(""))
    section = F.concat(title, F.lit("\n**Q:** "), "question", F.lit("\n\n"), "lines")
    return _sections(pools.join(listed, "question_id").select(F.col("question_id").alias("place"), section.alias("section")), "Relevance worksheet", "Does the text of a candidate support an answer?  Labels go to their own file, not here.")


def photo_worksheet(questions: DataFrame, candidates: DataFrame) -> str:
    """The candidates with photos of every image question.

    ``questions`` has ``id, category, question, image_target``, ``candidates``
    ``question_id, doc_id, rating, text, image_url``.
    """
    line = F.concat(F.lit("- `"), F.col("doc_id").cast("string"), F.lit("` ("), X.plain_number("rating"), F.lit("★): "), "text", F.lit("\n  photo: "), F.coalesce("image_url", F.lit("")))
    order = F.struct(F.col("doc_id").cast("string").try_cast("long").alias("n"), F.col("doc_id").cast("string").alias("d"), line.alias("line"))
    listed = candidates.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["line"]), "\n").alias("lines"))
    rows = questions.where("image_target").join(listed, F.col("id") == F.col("question_id"), "left")
    section = F.concat(F.lit("## "), "id", F.lit(" ["), "category", F.lit("]\n**Q:** "), "question", F.lit("\n\n"), F.coalesce("lines", F.lit("(no candidate with a photo)")))
    return _sections(rows.select(F.col("id").alias("place"), section.alias("section")), "Photo worksheet", "Pick the photo that proves most, one for each question.  Picks go to their own file, not here.")


def datasheet_document(stats: Mapping, by_type: DataFrame, manifest: Mapping | None = None, limitations: str = "") -> str:
    """A benchmark's datasheet from ``benchmark.datasheet_stats`` and counts by type (``type, total, negative``)."""
    composition = (
        f"{stats['total']} questions, {stats['n_negative']} of them negative; {stats['n_abstention']} answers abstain.  Relevant documents per question: "
        f"{stats['min_relevant']} to {stats['max_relevant']}, {stats['mean_relevant']} on average; citations per grounded answer: {stats['mean_citations']}."
    )
    photos = f"{stats['n_with_photo']} of {stats['n_image_target']} image questions ({stats['image_coverage_pct']} %) have a photo."
    origin = f"Built from a corpus of {manifest['n_rows']} rows with the fingerprint `{manifest['fingerprint']}`." if manifest else "No manifest of the corpus was given."
    held_out = "The questions must never be trained on; the leakage manifest holds a hash of each."
    return _joined("# Datasheet", "## Composition", composition, markdown_table(by_type, "type"), photos, "## Limitations" if limitations else "", limitations, "## Held out", held_out, "## Provenance", origin)


def winloss_document(details: DataFrame, questions: DataFrame, why: Mapping[str, str] | None = None) -> str:
    """What two retrievers showed where they differ most, with a reader's reasons where there are any.

    ``details`` is what ``studies.winloss_details`` gives; ``questions`` has ``query_id, type, text``.
    """
    mark = F.when(F.col("is_relevant"), "✅").otherwise("❌")
    line = F.format_string("- %s `%s` (score %.3f): %s", mark, F.col("doc_id").cast("string"), F.col("score").cast("double"), F.col("snippet"))
    shown = details.groupBy("query_id", "winner", "retriever").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    both = shown.groupBy("query_id", "winner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("retriever", "lines"))), lambda x: F.concat(F.lit("**"), x["retriever"], F.lit("**\n"), x["lines"])), "\n\n").alias("lists"))
    rows = both.join(questions, "query_id").orderBy("winner", "query_id").collect()  # a few chosen questions
    parts = [f"## {r['winner']} wins: `{r['query_id']}` ({r['type']})\n\n**Q:** {r['text']}\n\n{r['lists']}\n\n**Why:** {(why or {}).get(str(r['query_id']), '(not reviewed yet)')}" for r in rows]
    return _joined("# Where retrievers differ", *parts)


def appendix_document(rows: DataFrame) -> str:
    """Worked transcripts, from ``answers.appendix_rows``."""
    parts = []
    for r in rows.collect():  # a few chosen transcripts
        flags = r["context_photo_flags"] or {}
        shown = "\n".join(f"- `{d}` (has_photo: {'yes' if flags.get(d) else 'no'})" for d in r["context_doc_ids"] or []) or "- (none)"
        cited = "no citations" if not r["n_citations"] else f"{r['n_citations']} citation(s), {r['n_fabricated'] or 'none'} fabricated"
        expected = "expected" if r["abstention_correct"] == r["abstained"] else "not expected"
        parts.append(f"## {r['label']}: `{r['question_id']}`\n\n*{r['note']}*\n\n**Question:** {r['question']}\n\n**Documents shown:**\n{shown}\n\n**Answer:**\n\n> {r['answer_text']}\n\n**Scores:** abstained: {r['abstained']} ({expected}); format kept: {r['format_ok']}; {cited}.")
    return _joined("# Worked transcripts", *parts)


def recall_figure(table: DataFrame, path: str, metric: str = "recall") -> Path:
    """Means by ``k`` with intervals, a line for each retriever, as a PNG.  Needs matplotlib."""
    import matplotlib

    matplotlib.use("Agg")
    from matplotlib import pyplot

    figure, axes = pyplot.subplots(figsize=(6, 4))
    rows = table.orderBy("retriever", "k").collect()  # one row per k and retriever
    for name in sorted({r["retriever"] for r in rows}):
        own = [r for r in rows if r["retriever"] == name]
        mean = [r[f"{metric}_mean"] for r in own]
        error = [[r[f"{metric}_mean"] - r[f"{metric}_ci_lo"] for r in own], [r[f"{metric}_ci_hi"] - r[f"{metric}_mean"] for r in own]]
        axes.errorbar([r["k"] for r in own], mean, yerr=error, marker="o", capsize=3, label=name)
    axes.set_xlabel("k")
    axes.set_ylabel(f"{metric}@k")
    axes.legend()
    figure.savefig(path, dpi=150, bbox_inches="tight")
    pyplot.close(figure)
    return Path(path)
