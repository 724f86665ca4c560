"""Next-best actions: seven rules over contacts, their opportunities and evidence types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the rules.
DRIVER_EVIDENCE = ["cidade_base", "rota", "veiculo", "veiculo_tipo", "carroceria", "tipo_veiculo"]
TRADE_EVIDENCE = ["empresa", "cnpj", "origem", "destino", "contato_qualificado"]
TRADE_KINDS, TRADE_TAGS = ["lead", "fornecedor"], ["cotacao", "frete", "carga", "cotação"]


def _list(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def actions(contacts: DataFrame, opportunities: DataFrame, evidence: DataFrame, now: Column) -> DataFrame:
    """(contact_id, action_type, priority_score, opportunity_id, missing).

    contacts: contact_id, kind, tags, score, messages, summary, last_at; opportunities: contact_id, opportunity_id,
    opportunity_type, status, score; evidence: contact_id, evidence_type. Of several open quotes the one with the smallest id counts.
    """
    open_quote = (F.col("opportunity_type") == "cotacao_frete") & F.col("status").isin("nova", "open")
    of = opportunities.groupBy("contact_id").agg(F.min(F.when(open_quote, F.struct("opportunity_id", F.col("score").alias("s")))).alias("quote"), F.max(F.col("opportunity_type") == "motorista_parceiro").alias("partner"))
    seen = evidence.groupBy("contact_id").agg(F.collect_set(F.lower("evidence_type")).alias("seen"))
    c = contacts.join(of, "contact_id", "left").join(seen, "contact_id", "left")
    none = F.array().cast("array<string>")
    score, have, lowered = F.coalesce("score", F.lit(0)).cast("double"), F.coalesce("seen", none), F.transform(F.coalesce("tags", none), F.lower)
    # a score of zero or null falls to the contact's
    quote = F.coalesce(F.nullif(F.col("quote.s").cast("double"), F.lit(0.0)), score)
    trade = F.col("kind").isin(TRADE_KINDS)
    lacks = lambda wanted: F.array_sort(F.array_except(_list(wanted), have))
    bonus = F.least(F.lit(20), F.floor(F.coalesce("messages", F.lit(0)) / 10))
    rules = [
        ("followup_cotacao", F.col("quote").isNotNull(), F.greatest(quote, score), F.col("quote.opportunity_id"), none),
        ("qualificar_motorista", (F.col("kind") == "motorista") & (F.size(lacks(DRIVER_EVIDENCE)) > 0), F.least(F.lit(100.0), score + bonus), None, lacks(DRIVER_EVIDENCE)),
        ("convidar_motorista_para_plataforma", F.array_contains(lowered, "fretebras") | F.coalesce("partner", F.lit(False)), F.greatest(F.lit(70.0), score), None, none),
        ("pedir_cnpj", (F.coalesce(trade, F.lit(False)) | F.arrays_overlap(lowered, _list(TRADE_TAGS))) & ~F.array_contains(have, "cnpj"), score, None, none),
        ("completar_dados_comerciais", trade & (F.coalesce("summary", F.lit("")) != "") & (F.size(lacks(TRADE_EVIDENCE)) > 0), score, None, lacks(TRADE_EVIDENCE)),
        ("reativar_contato", (score >= 60) & (F.col("last_at") < now - F.make_dt_interval(F.lit(60))), score, None, none),
        ("revisar_alto_potencial", score >= 80, score, None, none),
    ]
    made = [F.when(when, F.struct(F.lit(name).alias("action_type"), s.cast("double").alias("priority_score"), (F.lit(None) if i is None else i).cast("long").alias("opportunity_id"), missing.alias("missing"))) for name, when, s, i, missing in rules]
    return c.select("contact_id", F.inline(F.array_compact(F.array(*made))))
