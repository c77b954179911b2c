"""References to records that do not exist, by anti-join of distinct keys.

The distinct non-null references and moments of use are anti-joined with the
targets that exist at that moment; what is left is joined with the earliest
target of its name, which tells why, and back to the referring rows.  A name
used a million times is looked up once per moment of use, and targets are
combined before they are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.functions.names import name_key, object_ref, strip
from tamarack.operators.rows import one_per_key
from tamarack.plans.lexer import LexError, tokenize
from tamarack.workspace import settle


def orphan_keys(refs: DataFrame, targets: DataFrame, key: list[str], at: str) -> DataFrame:
    """Distinct (key, at) of ``refs`` that have no target living then, with the reason.

    ``targets`` has the key columns, created_at and deleted_at (null: still
    there).  A target lives at t if created_at <= t < deleted_at.  reason is
    missing (no target of that key at all), deleted (some target had begun by
    then) or late (all begin later).  Null keys or moments are no references;
    a target without created_at never lives but counts as known.
    """
    asked = refs.select(*key, at).dropna().distinct()
    known = targets.select(*key, F.col("created_at").alias("__from"), F.col("deleted_at").alias("__to")).dropna(subset=key)
    # of several targets that begin together the one that lasts longest says it all
    spans = known.filter("__from is not null").groupBy(*key, "__from").agg(F.max(F.struct(F.col("__to").isNull(), "__to")).alias("__last")).select(*key, "__from", F.col("__last.__to").alias("__to"))
    a, t = asked.alias("a"), spans.alias("t")
    lives = (F.col("t.__from") <= F.col(f"a.{at}")) & (F.col("t.__to").isNull() | (F.col("t.__to") > F.col(f"a.{at}")))
    lost = a.join(t, reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"t.{k}") for k in key]) & lives, "left_anti")
    first = known.groupBy(*key).agg(F.min("__from").alias("__first"), F.lit(True).alias("__known"))
    reason = F.when(F.col("__known").isNull(), "missing").when(F.col("__first") <= F.col(at), "deleted").otherwise("late")
    return lost.join(first, key, "left").select(*key, at, reason.alias("reason"))


def sql_sources(text: str | None) -> list[str]:
    """Tables and queries that a record source names, in order: the single name, or every name after FROM or JOIN.

    Name keys are returned.  String literals, aliases and columns don't count;
    subqueries do; a comma list or parentheses after FROM are followed.  Null,
    empty and unreadable texts name nothing.
    """
    if text is None or not text.strip(" \t\r\n ;"):
        return []
    bare = text.strip(" \t\r\n ")
    if not bare.lower().startswith("select") or (len(bare) > 6 and (bare[6].isalnum() or bare[6] == "_")):
        bare = bare.rstrip("; \t\r\n")
        return [key] if (key := _key(bare)) else []
    try:
        tokens = tokenize(bare)
    except LexError:
        return []
    out: list[str] = []
    depth, expecting, in_from = 0, False, {}
    k = 0
    while k < len(tokens):
        t = tokens[k]
        word = t.text.lower() if t.kind == "ident" and not t.quoted else ""
        if t.text == "(" and t.kind == "op":
            depth += 1
            in_from[depth] = in_from.get(depth - 1, False) and expecting
        elif t.text == ")" and t.kind == "op":
            in_from.pop(depth, None)
            depth -= 1
            expecting = False
        elif word == "select":
            in_from[depth], expecting = False, False
        elif word in ("from", "join"):
            in_from[depth], expecting = True, True
        elif word in ("where", "group", "having", "order", "on", "union", "inner", "left", "right", "outer", "cross", "as", "limit"):
            expecting = False
            if word in ("where", "group", "having", "order", "union"):
                in_from[depth] = False
        elif t.text == "," and t.kind == "op":
            expecting = in_from.get(depth, False)
        elif t.kind == "ident" and expecting:
            name = t.text
            while k + 2 < len(tokens) and tokens[k + 1].text == "." and tokens[k + 2].kind == "ident":
                name, k = tokens[k + 2].text, k + 2
            if (key := _key(name)) and key not in out:
                out.append(key)
            expecting = False
        k += 1
    return out


def _key(name: str) -> str:
    name = name.strip(" \t\r\n \u3000")
    if len(name) >= 2 and name[0] == "[" and name[-1] == "]":
        name = name[1:-1].strip(" \t\r\n \u3000")
    return name.lower()


def field_ref(text: str | None) -> list[str]:
    """[object key or '', field key] of a control source; [] for empty texts and expressions."""
    text = (text or "").strip(" \t\r\n \u3000")
    if not text or text.startswith("="):
        return []
    dot = -1
    inside = False
    for k, ch in enumerate(text):
        inside = True if ch == "[" else False if ch == "]" else inside
        if ch == "." and not inside:
            dot = k
    if dot < 0:
        return ["", _key(text)] if _key(text) else []
    before = text[:dot]
    at = -1
    inside = False
    for k, ch in enumerate(before):
        inside = True if ch == "[" else False if ch == "]" else inside
        if ch == "." and not inside:
            at = k
    return [_key(before[at + 1 :]), _key(text[dot + 1 :])]


def _parsed(fn, kind: str = "array<string>"):
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            known: dict = {}
            yield pd.Series([known[t] if t in known else known.setdefault(t, fn(t)) for t in batch], dtype=object)

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, kind)


def form_orphans(controls: DataFrame, forms: DataFrame, objects: DataFrame, fields: DataFrame) -> DataFrame:
    """ref_field, record_id, reason, period_month of every reference without a target at its row's exported_at.

    ref_field is source_object, record_source or control_source.  A record
    source with several lost targets gives one row, of the reason that comes
    first of missing, deleted, late.  A field reference is judged only if all
    objects of its form's record source exist then.
    """
    form_rows = settle(one_per_key(forms.select("form_id", "loaded_at", "db_file", "form_name", "record_source", "created_at", "deleted_at", "exported_at").filter("form_id is not null"), ["form_id"], ["loaded_at", "db_file", "form_name", "record_source", "created_at", "deleted_at", "exported_at"], "loaded_at"))
    control_cols = ["loaded_at", "form_id", "db_file", "source_object", "control_source", "exported_at"]
    control_rows = one_per_key(controls.select("control_id", *control_cols).filter("control_id is not null and (source_object <> '' or control_source <> '')"), ["control_id"], control_cols, "loaded_at")
    control_rows = settle(control_rows)
    key = ["db_file", "kind", "name"]
    code = F.when(F.col("obj_type") == 1, "table").when(F.col("obj_type") == 5, "query").when(F.col("obj_type") == -32764, "report")
    catalog = objects.select("db_file", code.alias("kind"), name_key(F.col("obj_name")).alias("name"), "created_at", "deleted_at")
    targets = form_rows.select("db_file", F.lit("form").alias("kind"), name_key(F.col("form_name")).alias("name"), "created_at", "deleted_at").unionByName(catalog)
    sources = catalog.filter("kind in ('table', 'query')").withColumn("kind", F.lit("source"))

    kind, name = object_ref(F.col("source_object"))
    uses = control_rows.filter(strip(F.col("source_object")) != "").select(F.col("control_id").alias("record_id"), "db_file", kind.alias("kind"), name.alias("name"), "exported_at")
    lost_objects = uses.join(orphan_keys(uses, targets, key, "exported_at"), [*key, "exported_at"]).select(F.lit("source_object").alias("ref_field"), "record_id", "reason", "exported_at")

    texts = form_rows.filter(strip(F.col("record_source")) != "").select("record_source").distinct().withColumn("names", _parsed(sql_sources)(F.col("record_source")))
    named = settle(form_rows.filter(strip(F.col("record_source")) != "").join(texts, "record_source").select("form_id", "db_file", "exported_at", "names"))
    reads = named.select(F.col("form_id").alias("record_id"), "db_file", F.lit("source").alias("kind"), F.explode("names").alias("name"), "exported_at")
    rank = F.array_position(F.array(F.lit("missing"), F.lit("deleted"), F.lit("late")), F.col("reason"))
    lost_sources = reads.join(orphan_keys(reads, sources, key, "exported_at"), [*key, "exported_at"]).groupBy("record_id", "exported_at").agg(F.min_by("reason", rank).alias("reason")).select(F.lit("record_source").alias("ref_field"), "record_id", "reason", "exported_at")

    refs = control_rows.filter((strip(F.col("control_source")) != "") & ~strip(F.col("control_source")).startswith("=")).select("control_id", "form_id", "db_file", "exported_at", "control_source")
    parts = refs.select("control_source").distinct().withColumn("ref", _parsed(field_ref)(F.col("control_source"))).filter("size(ref) = 2")
    bound = refs.join(parts, "control_source").join(named.filter("size(names) > 0").select("form_id", "names"), "form_id").select("control_id", "db_file", "exported_at", F.col("ref")[0].alias("owner"), F.col("ref")[1].alias("field"), "names")
    bound = settle(bound)
    scope = bound.select("db_file", "exported_at", "names").distinct()
    whole = scope.select("db_file", "exported_at", "names", F.lit("source").alias("kind"), F.explode("names").alias("name"))
    broken = whole.join(orphan_keys(whole, sources, key, "exported_at"), [*key, "exported_at"], "left_semi").select("db_file", "exported_at", "names").distinct()
    judged = bound.join(broken, ["db_file", "exported_at", "names"], "left_anti").withColumn("owners", F.expr("if(owner = '', names, array(owner))"))
    field_targets = fields.select("db_file", name_key(F.col("obj_name")).alias("owner"), name_key(F.col("field_name")).alias("field"), "created_at", "deleted_at")
    asked = judged.select("db_file", "owners", "field", "exported_at").distinct().withColumn("owner", F.explode("owners"))
    one = ["db_file", "owner", "field"]
    each = asked.join(orphan_keys(asked, field_targets, one, "exported_at"), [*one, "exported_at"], "left")
    # a field sought in several objects is lost if it is so in all of them
    state = each.groupBy("db_file", "owners", "field", "exported_at").agg(F.count("*").alias("n"), F.count("reason").alias("n_lost"), F.collect_set("reason").alias("reasons"))
    lost = state.filter("n_lost = n").withColumn("reason", F.when(F.array_contains("reasons", "deleted"), "deleted").when(F.array_contains("reasons", "late"), "late").otherwise("missing")).drop("n", "n_lost", "reasons")
    lost_fields = judged.join(lost, ["db_file", "owners", "field", "exported_at"]).select(F.lit("control_source").alias("ref_field"), F.col("control_id").alias("record_id"), "reason", "exported_at")
    found = reduce(DataFrame.unionByName, [lost_objects, lost_sources, lost_fields])
    return found.select("ref_field", "record_id", "reason", F.date_format("exported_at", "yyyy-MM").alias("period_month"))


def orphan_counts(found: DataFrame) -> DataFrame:
    """Rows per ref_field, reason and month."""
    return found.groupBy("ref_field", "reason", "period_month").agg(F.count("*").alias("n_orphans"))
