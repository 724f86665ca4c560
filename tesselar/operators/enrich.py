"""Signals of contacts' texts and what the rules make of them: one pass over the text, then expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselar.functions import text as T
from tesselar.functions.vocabulary import SPECIFICITY, Vocabulary
from tesselar.operators.rollup import corpus

PRICING, OPERATION = ("cotacao", "valor", "frete"), ("coleta", "frete", "entrega", "carga")


def signals(rows: DataFrame, text: str = "corpus", vocabulary: Vocabulary | None = None) -> DataFrame:
    """Rows (contact_id, corpus, ...) with all detected lists."""
    v, c = vocabulary or Vocabulary(), F.col(text)
    return rows.withColumns({
        "cnpjs": T.cnpjs(c), "cpfs": T.cpfs(c), "plates": T.plates(c), "emails": T.emails(c), "types": T.keywords(c, v.vehicle_types), "bodies": T.keywords(c, v.vehicle_bodies),
        "intents": T.intents(c, v.intents), "roles": T.roles(c, F.col("contact_id"), v.roles), "routes": T.routes(c), "mentions": T.platform_mentions(c),
    })


def _any(name: str) -> Column:
    return F.size(name) > 0


def kind() -> Column:
    """The first rule that holds, over the columns of ``signals`` with messages and conversations."""
    vehicle, priced = _any("types") | _any("bodies"), T.has(F.col("intents"), *PRICING)
    driver = T.has(F.col("roles"), "motorista") | T.has(F.col("intents"), "motorista") | (T.has(F.col("intents"), "disponibilidade") & vehicle) | (_any("plates") & vehicle) | _any("mentions")
    regular = (F.coalesce("conversations", F.lit(0)) >= 3) & (F.coalesce("messages", F.lit(0)) >= 20) & T.has(F.col("intents"), *OPERATION)
    return F.when(F.col("contact_id").startswith("group:"), "grupo").when(regular, "cliente").when(driver, "motorista").when(vehicle & priced, "fornecedor").when(priced, "lead").otherwise("desconhecido")


def settled_kind(current: Column, new: Column, mentioned: Column, group: Column) -> Column:
    """Never to a less specific kind; a platform mention makes a driver of three kinds."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(SPECIFICITY) for x in (k, i)])
    now = F.coalesce(current, F.lit("desconhecido"))
    return F.when(mentioned & ~group & now.isin("desconhecido", "lead", "grupo"), "motorista").when(F.coalesce(rank[new], F.lit(0)) >= F.coalesce(rank[now], F.lit(0)), new).otherwise(now)


def tags() -> Column:
    """Over the columns of ``signals`` with kind, accounts and old_tags; sorted and distinct."""
    one = lambda when, *names: F.when(when, F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>"))
    k = F.col("kind")
    parts = [
        F.coalesce("old_tags", F.array().cast("array<string>")), F.array(F.lit("whatsapp")), one(F.col("contact_id").startswith("group:"), "grupo"), one(_any("mentions"), "fretebras", "motorista"),
        F.col("intents"), F.col("roles"), one(_any("types") | _any("bodies"), "veiculo"), one(_any("cnpjs"), "documento", "cnpj"), one(_any("cpfs"), "documento", "cpf"), one(_any("plates"), "documento", "placa"),
        one(F.coalesce("accounts", F.lit(0)) > 1, "multicanal"), F.when(~k.isin("desconhecido", "grupo", ""), F.array(k)).otherwise(F.array().cast("array<string>")), one(k == "cliente", "cliente_potencial"),
    ]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def enrich(contacts: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Contacts (contact_id, corpus, messages, conversations, accounts, current_kind, old_tags) with kind, tags, scores and summary."""
    found = signals(contacts, "corpus", vocabulary)
    found = found.withColumn("kind", settled_kind(F.col("current_kind"), kind(), _any("mentions"), F.col("contact_id").startswith("group:"))).withColumn("tags", tags())
    c = F.col
    return found.withColumns({
        "opportunity_score": T.opportunity_score(c("intents"), c("tags"), c("messages"), c("cnpjs"), _any("mentions")), "risk_score": T.risk_score(c("intents")), "subject": T.conversation_subject(c("intents"), c("types")),
        "summary": T.contact_summary(c("messages"), c("conversations"), c("kind"), c("intents"), c("tags"), c("types"), c("bodies"), _any("mentions")),
    })


def evidence(enriched: DataFrame) -> DataFrame:
    """(contact_id, evidence_type, evidence_value, confidence), a row for each find."""

    def each(column: str, name: str, confidence: float) -> Column:
        return F.transform(column, lambda v: F.struct(F.lit(name).alias("evidence_type"), v.alias("evidence_value"), F.lit(confidence).alias("confidence")))

    def one(when: Column, name: str, value: Column, confidence: float) -> Column:
        return F.when(when, F.array(F.struct(F.lit(name).alias("evidence_type"), value.alias("evidence_value"), F.lit(confidence).alias("confidence"))))

    lists = [each(a, b, x) for a, b, x in (("cnpjs", "cnpj", 0.9), ("cpfs", "cpf", 0.9), ("plates", "placa", 0.9), ("emails", "email", 0.9), ("types", "vehicle_type", 0.9), ("bodies", "vehicle_body", 0.9), ("intents", "intent", 0.8), ("roles", "role", 0.8), ("routes", "route", 0.7))]
    lists.append(one(~F.col("kind").isin("desconhecido", "unknown", ""), "tipo_relacionamento", F.col("kind"), 0.75))
    lists += [one(_any("mentions"), a, F.lit(b), 0.98) for a, b in (("source_domain", "fretebras"), ("role", "motorista"))]
    return enriched.select("contact_id", F.inline(F.flatten(F.array_compact(F.array(*lists)))))


def timeline(enriched: DataFrame, first: str = "first_at", last: str = "last_at") -> DataFrame:
    """(contact_id, event_type, importance), in fixed order with their position."""
    rules = [
        (F.col(first).isNotNull(), "first_contact", "low"), (F.col(last).isNotNull(), "last_contact", "low"), (T.has(F.col("intents"), "cotacao"), "quote_detected", "high"), (_any("types") | _any("bodies"), "vehicle_detected", "medium"),
        (_any("cnpjs") | _any("cpfs") | _any("plates"), "document_detected", "medium"), (T.has(F.col("intents"), "reclamacao"), "complaint_detected", "high"), (T.has(F.col("tags"), "multicanal"), "multichannel_detected", "medium"), (_any("mentions"), "fretebras_detected", "high"),
    ]
    events = F.array_compact(F.array(*[F.when(w, F.struct(F.lit(n).alias("event_type"), F.lit(i).alias("importance"))) for w, n, i in rules]))
    return enriched.select("contact_id", F.posexplode(events).alias("position", "e")).select("contact_id", "position", "e.*")


def opportunities(enriched: DataFrame) -> DataFrame:
    """(contact_id, opportunity_type, score, status)."""
    rules = [(T.has(F.col("intents"), "cotacao", "frete", "coleta"), "cotacao_frete"), (F.col("kind") == "motorista", "motorista_parceiro"), (F.col("kind") == "fornecedor", "fornecedor_potencial")]
    found = F.array_compact(F.array(*[F.when(w, F.lit(n)) for w, n in rules]))
    return enriched.select("contact_id", F.explode(found).alias("opportunity_type"), F.col("opportunity_score").alias("score"), F.lit("nova").alias("status"))


def conversation_signals(messages: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(conversation_id, contact_id, messages, corpus, subject, summary and all lists of ``signals``) for each conversation.

    messages: conversation_id, contact_id, position, text. All messages are counted; the texts are those of a conversation's first and last messages
    with text, as ``rollup.corpus`` joins them. Positions tell the messages of a conversation apart.
    """
    counts = messages.groupBy("conversation_id", "contact_id").agg(F.count(F.lit(1)).alias("messages"))
    rows = counts.join(corpus(messages, "conversation_id", "position", "text"), "conversation_id", "left").withColumn("corpus", F.coalesce("corpus", F.lit("")))
    found = signals(rows, "corpus", vocabulary)
    return found.withColumns({"subject": T.conversation_subject(F.col("intents"), F.col("types")), "summary": T.conversation_summary(F.col("messages"), F.col("intents"))})
