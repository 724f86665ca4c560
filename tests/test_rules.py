"""The rule engine by literal cases, both ways."""

import datetime

from pyspark.sql import functions as F

from tesselar.operators import actions, enrich


def enriched(spark, **over):
    row = {"contact_id": "55", "corpus": "", "messages": 1, "conversations": 1, "accounts": 1, "current_kind": None, "old_tags": None} | over
    df = spark.createDataFrame([tuple(row.values())], "contact_id string, corpus string, messages int, conversations int, accounts int, current_kind string, old_tags array<string>")
    return enrich.enrich(df)


def test_kinds(spark):
    for over, want in [
        ({"corpus": "coleta amanhã", "messages": 25, "conversations": 5}, "cliente"), ({"corpus": "sou motorista"}, "motorista"), ({"corpus": "disponível com carreta"}, "motorista"), ({"corpus": "placa ABC1D23 truck"}, "motorista"),
        ({"corpus": "truck, quanto o frete"}, "fornecedor"), ({"corpus": "cotação"}, "lead"), ({"corpus": "oi"}, "desconhecido"), ({"contact_id": "group:1", "corpus": "motorista"}, "grupo"), ({"corpus": "oi", "current_kind": "cliente"}, "cliente"),
        ({"corpus": "veja fretebras.com.br/x", "current_kind": "lead"}, "motorista"), ({"corpus": "fretebras.com", "current_kind": "cliente"}, "cliente"),
    ]:
        assert enriched(spark, **over).first()["kind"] == want, over


def test_tags_evidence_timeline_opportunities(spark):
    e = enriched(spark, corpus="cotação, CNPJ 12.345.678/0001-95, reclamação", accounts=2, old_tags=["vip"])
    row = e.first()
    assert row["tags"] == ["cnpj", "cotacao", "documento", "lead", "multicanal", "reclamacao", "vip", "whatsapp"]
    assert (row["opportunity_score"], row["risk_score"]) == (45, 20)
    assert {(r.evidence_type, r.evidence_value) for r in enrich.evidence(e).collect()} == {("cnpj", "12.345.678/0001-95"), ("intent", "cotacao"), ("intent", "reclamacao"), ("role", "lead"), ("tipo_relacionamento", "lead")}
    t = enrich.timeline(e.withColumn("first_at", F.lit(1)).withColumn("last_at", F.lit(None)))
    assert [r.event_type for r in t.orderBy("position").collect()] == ["first_contact", "quote_detected", "document_detected", "complaint_detected", "multichannel_detected"]
    assert [r.opportunity_type for r in enrich.opportunities(e).collect()] == ["cotacao_frete"]


def test_action_thresholds(spark):
    now = datetime.datetime(2024, 6, 1)
    rows = [("a", "x", ["FRETEBRAS"], 79.0, 5, None, None), ("b", "x", None, 80.0, 5, None, datetime.datetime(2024, 1, 1)), ("c", "lead", [], None, None, "s", None)]
    c = spark.createDataFrame(rows, "contact_id string, kind string, tags array<string>, score double, messages int, summary string, last_at timestamp_ntz")
    o = spark.createDataFrame([("a", 7, "cotacao_frete", "nova", 0.0), ("b", 8, "cotacao_frete", "done", 9.0)], "contact_id string, opportunity_id long, opportunity_type string, status string, score double")
    e = spark.createDataFrame([("c", "cnpj")], "contact_id string, evidence_type string")
    got = {(r.contact_id, r.action_type): r for r in actions.actions(c, o, e, F.lit(now).cast("timestamp_ntz")).collect()}
    assert set(got) == {("a", "followup_cotacao"), ("a", "convidar_motorista_para_plataforma"), ("b", "reativar_contato"), ("b", "revisar_alto_potencial"), ("c", "completar_dados_comerciais")}
    assert got["a", "followup_cotacao"].priority_score == 79.0 and "cnpj" not in got["c", "completar_dados_comerciais"].missing
