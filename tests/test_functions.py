"""Text and key functions by literal cases."""

from pyspark.sql import functions as F

from tesselar.functions import keys as K
from tesselar.functions import text as T
from tesselar.functions import vocabulary as V


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


def test_documents(spark):
    assert one(spark, T.cnpjs, "o CNPJ 12.345.678/0001-95 aqui") == ["12.345.678/0001-95"]
    assert one(spark, T.cpfs, "123.456.789-09") == ["123.456.789-09"]
    assert one(spark, T.cpfs, "12345678901234") == []
    assert one(spark, T.plates, "abc-1234 e ABC1D23") == ["abc-1234", "ABC1D23"]
    assert one(spark, T.emails, "a.b@c.com.br, x@y") == ["a.b@c.com.br"]
    assert one(spark, T.cnpjs, None) == []


def test_keywords_see_unicode(spark):
    assert one(spark, lambda c: T.keywords(c, V.VEHICLE_TYPES), "CAMINHÃO e Truck, truck") == ["caminhão", "truck"]
    assert one(spark, lambda c: T.keywords(c, V.VEHICLE_BODIES), "çbau bauã") == []
    assert one(spark, T.intents, "quero COTAÇÃO de frete com motorista") == ["cotacao", "frete", "motorista"]
    assert one(spark, lambda c, i: T.roles(c, i), "motorista", "group:1") == ["grupo"]


def test_routes_and_self_declared(spark):
    assert one(spark, T.routes, "carga de São Paulo para Curitiba") == ["São Paulo → Curitiba"]
    assert one(spark, T.self_declared_cnpjs, "meu CNPJ é 12.345.678/0001-95") == ["12.345.678/0001-95"]
    assert one(spark, T.self_declared_cnpjs, "a cotação é pro CNPJ 12.345.678/0001-95") == []
    assert one(spark, T.affiliation, "bom dia, aqui é da Horizonte") == "Horizonte"


def test_scores_and_texts(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    row = spark.range(1).select(
        T.opportunity_score(a("cotacao"), a("multicanal"), F.lit(100), a("x"), F.lit(False)).alias("o"), T.risk_score(a("reclamacao", "atraso")).alias("r"),
        T.conversation_subject(a(), a()).alias("s"), T.conversation_subject(a("frete", "valor", "rota"), a("truck")).alias("t"), T.conversation_summary(F.lit(3), a("frete")).alias("c"),
        T.contact_summary(F.lit(3), F.lit(1), F.lit("lead"), a("frete"), a("frete", "whatsapp"), a(), a(), F.lit(False)).alias("k"),
    ).first()
    assert (row.o, row.r, row.s, row.t) == (60, 35, "geral", "frete/valor/truck")
    assert row.c == "Conversa com 3 mensagem(s). Tópicos principais: frete."
    assert row.k == "Stakeholder com 3 mensagens em 1 conversa(s). Classificado como lead. Sinais detectados: frete. Tags detectadas: frete."


def test_jids(spark):
    assert one(spark, K.phone_of_jid, "5511:3@s.whatsapp.net") == "5511" and one(spark, K.phone_of_jid, "1@g.us") is None and one(spark, K.phone_of_jid, "ab@s.whatsapp.net") is None
    for name, want in {"Ana": True, "Oficina 24h": True, "você": False, None: False, " ": False, "5511999": False, "1@lid": False, "149-155-674": False, "x": False}.items():
        assert one(spark, K.useful_push_name, name) is want
    cases = [
        (("55@s.whatsapp.net", None, None, "m"), "55"), (("9@g.us", "77:1@s.whatsapp.net", None, "m"), "77"), (("9@g.us", "5@lid", None, "m"), "lid:5"),
        (("9@g.us", None, '{"participantPn":"8@s.whatsapp.net"}', "m"), "8"), (("9@g.us", None, None, "m"), "group:9"), (("9@lid", None, '{"senderPn":"7@s.whatsapp.net"}', "m"), "7"),
        (("9@lid", None, None, "m"), "lid:9"), (("status@broadcast", None, None, "m"), "broadcast:status"), ((None, None, None, "m"), "unknown:m"), (("z", None, None, "m"), "unknown:m"),
    ]
    for values, want in cases:
        assert one(spark, K.contact_id, *values) == want


def test_message_text(spark):
    for body, want in {'{"conversation":"a"}': "a", '{"conversation":null,"imageMessage":{"caption":"x"}}': None, '{"imageMessage":{"caption":"x"}}': "x", '{"documentMessage":{"caption":"","fileName":"f"}}': "f", "no json": None, '{"contactMessage":{"displayName":"d"}}': "d"}.items():
        assert one(spark, K.message_text, body) == want


def test_identities(spark):
    cases = {("email", " A@B.co "): ("email", "a@b.co", True), ("whatsapp", "+55 11 98888-7777"): ("phone", "+5511988887777", True), ("phone", "5511988887777"): ("phone", "+5511988887777", True), ("instagram", "https://x.com/me/?a"): ("instagram", "x.com/me", False), ("whatsapp", "A@lid"): ("whatsapp", "a@lid", False), ("foo", " Z "): ("foo", "Z", False)}
    for values, want in cases.items():
        x = one(spark, K.identity, *values)
        assert (x.type, x.value, x.strong) == want and len(x.hash) == 64
    assert one(spark, K.identity, "phone", "123") is None and one(spark, K.identity, "email", "x") is None


def test_companies(spark):
    assert one(spark, K.company_name, "ACME Transportes Ltda.") == "acme transportes" and one(spark, K.cnpj, "12.345.678/0001-95") == "12345678000195" and one(spark, K.cnpj_root, "12.345.678/0002-00") == "12345678"
    assert one(spark, K.domain, "https://www.Acme.com/x?y") == "acme.com" and one(spark, K.generic_webmail, "a@GMAIL.com")


def test_payload_hash_ignores_order(spark):
    assert one(spark, K.payload_hash, '{"a":1,"b":{"d":2,"c":3}}') == one(spark, K.payload_hash, '{"b":{"c":3,"d":2},"a":1}')
