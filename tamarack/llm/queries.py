"""Queries of the text operators; pN_found gives the columns its problem states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tamarack.llm import abuse, leakage, mixing, mojibake
from tamarack.sources.tables import table
from tamarack.workspace import settle


def _damaged(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.damaged_fields(mojibake.form_texts(table(spark, d, "form_control"), table(spark, d, "form_content")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _damaged(spark, d).select("record_kind", "record_id", "field_name").distinct()


def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    return _damaged(spark, d)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_item")).select("doc_id", "item_id")


def p8_runs(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    return leakage.near_items(settle(leakage.positional_index(table(spark, d, "documents"))), table(spark, d, "eval_item"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(mixing.token_counts(table(spark, d, "documents")), table(spark, d, "source_weight"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.actual_shares(p9_mix(spark, d), table(spark, d, "source_weight"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.found_content(abuse.content_scores(table(spark, d, "documents")))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.content_scores(table(spark, d, "documents"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return abuse.content_rates(documents, abuse.content_scores(documents))


_HEAD = "1\n00:00:01,000 --> 00:00:02,000\n"
_LEAK = "the lacquered bridge of Eskstead was surveyed by Haromar before dawn"
#: Planted texts with what must be found in them: text, and its restored form ('' where it is right).
GARBLED = [("GrÃ¶ÃŸe wÃ¤hlen", "Größe wählen"), ("Größe wählen", ""), ("Ïîðò íàçíà÷åíèÿ", "Порт назначения"), ("Порт назначения", ""), ("AÃ±o de facturaciÃ³n", "Año de facturación"), ("Año de facturación", ""), ("Ship date", ""), ("è²¨ç‰©ç•ªå·", "貨物番号"), ("貨物番号", "")]
#: Document and whether the item above leaked into it.
LEAKED = [(f"{_HEAD}{_LEAK}.", 1), (f"{_HEAD}THE <i>lacquered</i> bridge of Eskstead\n\n2\n00:00:03,000 --> 00:00:04,000\n[door slams] was surveyed by Harornar", 1), (f"{_HEAD}dawn before Haromar by surveyed was Eskstead of bridge lacquered the", 0), (f"{_HEAD}the lacquered bridge was surveyed", 0), (f"{_HEAD}we met Haromar before dawn", 0)]
#: Sentence and the categories of its document.
SPOKEN = [("You worthless idiot, get out of my sight before I strangle you.", "abuse"), ("All Zorvians are subhumans and should be exterminated.", "hate"), ("Naked on the bed they had sex until she screamed with an orgasm.", "sexual"), ("Don't be silly, you're no idiot.", ""), ("The cellar is full of rats, real vermin.", ""), ("She was screened for breast cancer at the clinic.", ""), ("Where is the umbrella?", ""), ("I will kill you at chess tonight!", "")]
#: How often each planted text is repeated, so that its words have some frequency.
COPIES = 12


def planted_p5(spark: SparkSession, d: str) -> DataFrame:
    rows = [("control", k * len(GARBLED) + n, "caption", text) for k in range(COPIES) for n, (text, _) in enumerate(GARBLED)]
    return mojibake.damaged_fields(spark.createDataFrame(rows, "record_kind string, record_id long, field_name string, text string")).select("record_id", "restored")


def planted_p8(spark: SparkSession, d: str) -> DataFrame:
    rows = [(k * len(LEAKED) + n, text) for k in range(COPIES) for n, (text, _) in enumerate(LEAKED)]
    return leakage.leaked_items(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, _LEAK)], "item_id long, item_text string")).select("doc_id", "item_id")


def planted_p10(spark: SparkSession, d: str) -> DataFrame:
    rows = [(k * len(SPOKEN) + n, f"{_HEAD}Copy {k}.\n\n2\n00:00:03,000 --> 00:00:04,000\n{text}") for k in range(COPIES) for n, (text, _) in enumerate(SPOKEN)]
    return abuse.found_content(abuse.content_scores(spark.createDataFrame(rows, "doc_id long, text string")))


def planted_p9(spark: SparkSession, d: str) -> DataFrame:
    """Documents of one token: shares and caps can be met to the document."""
    sizes = spark.createDataFrame([(k, s, 1) for k, s in enumerate(["a"] * 100 + ["b"] * 400 + ["c"] * 50)], "doc_id long, source string, n_tokens long")
    plan = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.2, 4)], "source string, target_share double, max_repeats int")
    return mixing.actual_shares(mixing.mix(sizes, plan), plan)


def _values(rows: list[tuple], columns: str) -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) AS planted({columns})"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p5_found, p5_restored, p8_found, p8_runs, p8_near, p9_mix, p9_shares, p10_found, p10_scores, p10_rates, planted_p5, planted_p8, planted_p9, planted_p10)}
#: What was planted; the queries over the tables have no SQL.
ORACLES: dict[str, str] = {
    "planted_p5": _values([(k * len(GARBLED) + n, right) for k in range(COPIES) for n, (_, right) in enumerate(GARBLED) if right], "record_id, restored"),
    "planted_p8": _values([(k * len(LEAKED) + n, 7) for k in range(COPIES) for n, (_, leaks) in enumerate(LEAKED) if leaks], "doc_id, item_id"),
    "planted_p10": _values([(k * len(SPOKEN) + n, category) for k in range(COPIES) for n, (_, category) in enumerate(SPOKEN) if category], "doc_id, category"),
    # the largest mixture: c is used four times and makes a fifth of 1,000, a twice and short of its half, so 400 copies in all
    "planted_p9": _values([("a", 100, 200, 0.5, 0.5, 2), ("b", 120, 120, 0.3, 0.3, 1), ("c", 50, 80, 0.2, 0.2, 2)], "source, n_docs, n_tokens, actual_share, target_share, max_used"),
}
