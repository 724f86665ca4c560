"""Word lists and patterns of the text rules. Each is a parameter of the rules that use it."""

from __future__ import annotations

from dataclasses import dataclass, field


# They must equal those that the rules are defined with.
VEHICLE_TYPES = ["carreta", "truck", "fiorino", "toco", "3/4", "van", "bitrem", "rodotrem", "VUC", "caminhão", "caminhao"]
VEHICLE_BODIES = ["baú", "bau", "sider", "graneleiro", "grade baixa", "grade-baixa", "refrigerado", "prancha", "cegonha", "munck", "guindaste", "basculante", "tanque", "caçamba", "cacamba"]
INTENTS = {
    "cotacao": ["cotação", "cotacao", "cotar", "orçamento", "orcamento", "orçar"],
    "coleta": ["coleta", "coletar", "buscar", "busca", "apanhar"],
    "frete": ["frete", "fretes", "transporte", "transportar"],
    "entrega": ["entrega", "entregar", "delivery"],
    "disponibilidade": ["disponível", "disponivel", "disponibilidade", "livre", "vaga"],
    "motorista": ["motorista", "motoristas", "condutor"],
    "carga": ["carga", "cargas", "mercadoria", "mercadorias"],
    "descarga": ["descarga", "descarregar", "descarregamento"],
    "nota_fiscal": ["nota fiscal", "NF", "nota", "NF-e", "NFe"],
    "comprovante": ["comprovante", "comprovantes", "recibo"],
    "pagamento": ["pagamento", "pagar", "pagamentos", "boleto", "PIX", "transferência"],
    "reclamacao": ["reclamação", "reclamacao", "problema", "problemas", "queixa", "insatisfeito"],
    "atraso": ["atraso", "atrasado", "atrasados", "atrasou", "demora", "demorou"],
    "suporte": ["suporte", "ajuda", "auxílio", "auxilio"],
    "valor": ["valor", "valores", "preço", "preco", "preços", "precos", "quanto"],
    "rota": ["rota", "rotas", "trajeto", "percurso"],
}
ROLES = {
    "motorista": ["motorista", "condutor", "chofer"],
    "financeiro": ["financeiro", "cobrança", "cobranca", "pagamento", "boleto"],
    "suporte": ["suporte", "atendimento", "SAC"],
    "lead": ["cotação", "cotacao", "orçamento", "orcamento", "quanto custa", "preço"],
}
#: Least to most specific.
SPECIFICITY = ["desconhecido", "lead", "fornecedor", "motorista", "cliente", "grupo"]
WEBMAIL = ["gmail.com", "hotmail.com", "outlook.com", "yahoo.com", "yahoo.com.br", "icloud.com", "live.com", "bol.com.br", "uol.com.br", "terra.com.br", "msn.com", "ig.com.br", "globo.com", "r7.com"]
TECHNICAL_MESSAGES = ["reactionMessage", "protocolMessage", "senderKeyDistributionMessage", "call", "pollUpdateMessage", "pollCreationMessage"]
CNPJ = r"\b\d{2}[.\s]?\d{3}[.\s]?\d{3}[/\s]?\d{4}[-\s]?\d{2}\b"
CPF = r"\b\d{3}[.\s]?\d{3}[.\s]?\d{3}[-\s]?\d{2}(?!\d)\b"
PLATE = r"\b[A-Z]{3}[-\s]?\d[A-Z0-9]\d{2}\b"
EMAIL = r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"
ROUTE = r"(?:de\s+([A-ZÀ-Ú][a-zA-ZÀ-ú\s]{2,20})\s+(?:para|p/|até)\s+([A-ZÀ-Ú][a-zA-ZÀ-ú\s]{2,20}))"
PLATFORM = r"(?:https?://)?(?:www\.)?fretebras\.com(?:\.br)?(?:/\S*)?"
SELF = r"(?:meu|minha|nosso|nossa|da\s+minha\s+empresa|aqui\s+(?:é|e)\s+da)"
AFFILIATION = r"\b(?:aqui\s+(?:é|e)\s+da|equipe|time)\s+([A-ZÀ-Ú][\wÀ-ú]{2,30})"
LEGAL_SUFFIX = r"\b(ltda|epp|eireli|me|s\.?\s?a\.?|sa|s/a|mei)\.?\s*$"


@dataclass(frozen=True)
class Vocabulary:
    """The lists that one run of the text rules works with."""

    vehicle_types: list = field(default_factory=lambda: VEHICLE_TYPES)
    vehicle_bodies: list = field(default_factory=lambda: VEHICLE_BODIES)
    intents: dict = field(default_factory=lambda: INTENTS)
    roles: dict = field(default_factory=lambda: ROLES)
