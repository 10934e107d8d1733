"""Pattern catalogue: identifiers, secrets, institution profile, name rules."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Pattern:
    """One scan predicate. ``validator`` names a check-digit rule."""

    id: str
    label: str
    source: str
    flags: str
    mask: str
    confidence: str = "medium"
    category: str = ""
    key: str = ""
    validator: str = ""
    hitl: tuple[int, int] = field(default=(0, 0))

    @property
    def kind(self) -> str:
        return self.category or self.id


# Patterns, labels, masks and their order (ties go to the earlier one).
_RG = r"(?:(?:RG|rg|Rg|Registro\s+Geral|registro\s+geral)[\s:nº°.]*(?:[A-Z]{2}[\s-]?)?\d{1,2}[.\s]?\d{3}[.\s]?\d{3}[.\s-]?\d?|\b\d{1,2}\.\d{3}\.\d{3}-\d\b)"
_LOW = "A-Za-záéíóúãõâêîôûàèìòùüçñ"
DEFAULT: tuple[Pattern, ...] = (
    Pattern("processo", "Processo Judicial", r"\b\d{7}[-.]?\d{2}[.]?\d{4}[.]?\d[.]?\d{2}[.]?\d{4}\b", "g", "[PROCESSO REMOVIDO]", "high", "process_number"),
    Pattern("cnpj", "CNPJ", r"\b\d{2}[.\s]?\d{3}[.\s]?\d{3}[/\s]?\d{4}[-.\s]?\d{2}\b", "g", "[CNPJ REMOVIDO]", "high"),
    Pattern("cpf", "CPF", r"\b\d{3}[.\s-]?\d{3}[.\s-]?\d{3}[.\s/-]?\d{2}\b", "g", "[CPF REMOVIDO]", "high"),
    Pattern("rg", "RG", _RG, "gi", "[RG REMOVIDO]", "high"),
    Pattern("cnh", "CNH", r"\b(?:CNH|cnh|Cnh|habilitação|habilitacao)[:\s]*\d{9,11}\b", "gi", "[CNH REMOVIDO]", "medium"),
    Pattern("sus", "Cartão SUS", r"\b[1-9]\d{2}\s?\d{4}\s?\d{4}\s?\d{4}\b", "g", "[SUS REMOVIDO]", "medium"),
    Pattern("nis_pis", "NIS/PIS", r"\b[12]\d{2}\.?\d{5}\.?\d{2}-?\d\b", "g", "[NIS REMOVIDO]", "medium"),
    Pattern("masp", "MASP", r"\b(?:MASP|masp|Masp)[:\s]*\d{1,3}[.\s]?\d{3,5}[.\s-]?\d{0,2}\b", "gi", "[MASP REMOVIDO]", "high"),
    Pattern("reds", "REDS", r"\b(?:REDS|reds|Reds)[:\s]*\d{4,}[-./]?\d{0,}\b", "gi", "[REDS REMOVIDO]", "high"),
    Pattern("placa_mercosul", "Placa Veicular", r"\b[A-Z]{3}\d[A-Z]\d{2}\b", "gi", "[PLACA REMOVIDA]", "medium", "plate"),
    Pattern("placa_antiga", "Placa Veicular", r"\b(?!(?:ISO|RFC|IEC|ITU|ICS|NBR|ABNT)[-\s]?\d)[A-Z]{3}[-\s]?\d{4}(?![-\d\/])", "gi", "[PLACA REMOVIDA]", "medium", "plate"),
    Pattern("email", "Email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "g", "[EMAIL REMOVIDO]", "high"),
    Pattern("telefone", "Telefone", r"\b(?:\+55\s?)?(?:\(?\d{2}\)?\s?)\d{4,5}[-.\s]?\d{4}\b", "g", "[TELEFONE REMOVIDO]", "medium", "phone"),
    Pattern("titulo_eleitor", "Título de Eleitor", r"\b\d{4}\s?\d{4}\s?\d{4}\b", "g", "[TÍTULO REMOVIDO]", "low"),
    Pattern("cep", "CEP", r"\b\d{5}[-.\s]?\d{3}\b", "g", "[CEP REMOVIDO]", "low"),
    Pattern("health_condition", "Dado de Saúde", rf"\b(?:portador[ae]?\s+de|diagnos(?:tic|e)ado[ae]?\s+(?:com|de)|soropositivo|HIV\s*\+|HIV\s+positivo|resultado\s+positivo\s+para|condição\s+médica[:\s]+|doença\s+(?:crônica|grave)[:\s]+)\s*([{_LOW}][{_LOW}\s]{{2,40}})", "gi", "[DADO DE SAÚDE REMOVIDO]", "medium", "health_data"),
)
DATE_OF_BIRTH = Pattern("date_of_birth", "Data de Nascimento", r"\b(?:nascido|nascimento|nasc\.?|DN|dn)[:\s]*\d{1,2}[\/.-]\d{1,2}[\/.-]\d{2,4}\b", "gi", "[DATA REMOVIDA]")
SECRETS: tuple[Pattern, ...] = (
    Pattern("aws_key", "AWS Access Key", r"\bAKIA[0-9A-Z]{16}\b", "g", "[AWS_KEY REMOVIDO]", "high"),
    Pattern("github_token", "GitHub Token", r"\bgh[pousr]_[A-Za-z0-9_]{36,}\b", "g", "[GITHUB_TOKEN REMOVIDO]", "high"),
    Pattern("stripe_key", "Stripe API Key", r"\bsk_(?:live|test)_[A-Za-z0-9]{16,}\b", "g", "[STRIPE_KEY REMOVIDO]", "high"),
    Pattern("db_connection", "DB Connection String", r"\b(?:mongodb|postgres|postgresql|mysql):\/\/[^:\s]+:[^@\s]+@[^\s\"']+", "gi", "[DB_CONNECTION REMOVIDA]", "high"),
    Pattern("api_key_assignment", "API Key (assignment)", r"\b(?:api[_-]?key|apikey|api_secret|access_token)\s*[:=]\s*['\"][A-Za-z0-9_\-]{20,}['\"]", "gi", "[API_KEY REMOVIDA]", "medium"),
    Pattern("bearer_token", "Bearer Token", r"\bbearer\s+[A-Za-z0-9_\-.]{20,}\b", "gi", "[BEARER_TOKEN REMOVIDO]", "medium"),
    Pattern("private_key", "Private Key (PEM)", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY-----", "g", "[PRIVATE_KEY REMOVIDA]", "high"),
)
PROFILE_PCMG: tuple[Pattern, ...] = (
    Pattern("pcmg:bo_numero", "Número de BO (Boletim de Ocorrência MG)", r"\bBO\s*(?:n[º°o]?\.?\s*)?\d{4}\/\d{6,8}\b", "gi", "[BO REMOVIDO]", "low", hitl=(3, 0)),
    Pattern("pcmg:inquerito", "Número de Inquérito Policial MG", r"\bI[Pp][Ll]?[-\s]*\d{3,6}\/\d{4}\b", "g", "[IPL REMOVIDO]", "low", hitl=(2, 0)),
    Pattern("pcmg:reds_complemento", "REDS — formato complementar", r"\bREDS[-\s]?\d{4}[-\/]\d{9,12}[-\/]\d{3,4}\b", "gi", "[REDS REMOVIDO]", "low", hitl=(2, 0)),
    Pattern("pcmg:termo_circunstanciado", "Número de Termo Circunstanciado MG", r"\bTC[-\s]*\d{3,6}\/\d{4}\b", "g", "[TC REMOVIDO]", "medium", hitl=(5, 0)),
)
OFFLINE: tuple[Pattern, ...] = (
    Pattern("processo", "Processo Judicial", DEFAULT[0].source, "g", "", key="IPL"),
    Pattern("cnpj", "CNPJ", DEFAULT[1].source, "g", "", key="CNPJ", validator="cnpj"),
    Pattern("cpf", "CPF", DEFAULT[2].source, "g", "", key="CPF", validator="cpf"),
    Pattern("cns", "Cartão SUS", DEFAULT[5].source, "g", "", key="CNS", validator="cns"),
    Pattern("titulo", "Título de Eleitor", r"\b(?:(?:t[íi]tulo(?:\s+de\s+eleitor)?)[:\s]*)?\d{4}\s?\d{4}\s?\d{4}\b", "gi", "", key="TITULO", validator="titulo"),
    Pattern("pis", "PIS/NIS", r"\b\d{3}[.\s]?\d{5}[.\s]?\d{2}[.\s-]?\d\b", "g", "", key="PIS", validator="pis"),
    Pattern("cnh", "CNH", r"\b(?:CNH|cnh|Cnh|habilita[çc][ãa]o)[:\s nº°]*\d{11}\b", "gi", "", key="CNH"),
    Pattern("rg", "RG", _RG, "gi", "", key="RG"),
    Pattern("email", "E-mail", DEFAULT[11].source, "g", "", key="EMAIL"),
    Pattern("telefone", "Telefone", r"(?<!\d)(?:\+55\s?)?\(?\d{2}\)?\s?\d{4,5}[-.\s]?\d{4}(?!\d)", "g", "", key="TEL"),
    Pattern("masp", "MASP", DEFAULT[7].source, "gi", "", key="MASP"),
    Pattern("reds", "REDS", DEFAULT[8].source, "gi", "", key="REDS"),
    Pattern("placa_mercosul", "Placa Veicular", DEFAULT[9].source, "gi", "", key="PLACA"),
    Pattern("placa_antiga", "Placa Veicular", r"\b[A-Z]{3}[-\s]?\d{4}(?![-\d/])", "gi", "", key="PLACA"),
    Pattern("cep", "CEP", DEFAULT[14].source, "g", "", key="CEP"),
)

_UP, _LO = "A-ZÁÉÍÓÚÃÕÂÊÎÔÛ", "a-záéíóúãõâêîôû"
_UPX, _LOX = _UP + "ÀÈÌÒÙÄËÏÖÜÇ", _LO + "àèìòùäëïöüç"
_NAME = rf"[{_UPX}][{_LOX}]+(?:\s+(?:d[aeo]\s+)?[{_UPX}][{_LOX}]+){{1,5}}"
NAME_MASK = "[NOME REMOVIDO]"
NAME_LABEL = "Possível nome"
#: Contextual name: (before, name, after).
NAME_RULE = (
    r"\b(?:delegad[oa]|chefe|colega|servidor|investigador|escriv[aã]o?|comissário|perito|agente|[Nn]ome(?:\s+completo)?|[Pp]aciente|[Cc]liente|[Rr]esponsável|[Rr]equerente|[Rr]equerido|[Aa]utor|[Rr]éu|[Rr]é|[Dd]etentor|[Pp]ortador|[Tt]itular|[Ii]nteressado)\s*:?\s+",
    rf"[{_UP}][{_LO}]+(?:\s+(?:d[aeo]\s+)?[{_UP}][{_LO}]+){{1,4}}",
    r"\b",
)
#: Name rules (id, label, before, after, flags); rule C is separate.
NER_RULES: tuple[tuple[str, str, str, str, str], ...] = (
    ("ner:A", "Nome (campo explícito)", r"(?:[Nn]ome(?:\s+[Cc]ompleto)?|[Nn]ome\s+d[oa]\s+(?:[Ss]uspeito|[Ii]nvestigado|[Pp]aciente|[Cc]onduzido|[Vv][íi]tima|[Cc]liente|[Uu]su[aá]rio|[Rr]espons[aá]vel))\s*:?\s+", "", "g"),
    ("ner:B", "Nome (honorífico)", r"\b(?:Sr\.|Sra\.|Srta\.|Dr\.|Dra\.|Prof\.?|Profa\.?|Del\.|Esc\.|Ag\.)\s+", r"\b", "g"),
    ("ner:D", "Nome (papel processual)", r"\b(?:[Tt]estemunha|[Vv][íi]tima|[Cc]onduzido|[Pp]reso|[Aa]utuado|[Ii]nvestigado|[Aa]cusado|[Dd]enunciado|[Ii]ndiciado|[Qq]uerente|[Qq]uerido|[Aa]utor|[Rr][eé]u|[Rr][eé]|[Ee]nvolvido|[Ss]uspeito)\s*[:\-–]\s*", r"\b", "g"),
    ("ner:E", "Nome (assinatura)", r"(?:[Aa]ssinado\s+(?:por|digital(?:mente)?|eletronicamente)\s*:?\s*|[Aa]ssinatura\s*:?\s*|[Rr]espons[aá]vel\s+técnico\s*:?\s*)", "", "g"),
    ("ner:F", "Nome (parentesco)", r"\b(?:[Ff]ilho|[Ff]ilha|[Cc][oô]njuge|[Ee]sposo|[Ee]sposa|[Gg]enitor|[Gg]enitora|[Nn]eto|[Nn]eta|[Ii]rm[aã]o?|[Pp]ai|[Mm][aã]e)\s+d[aeo]\s+", r"\b", "gi"),
    ("ner:G", "Nome (parêntese após cargo)", r"\b(?:delegad[oa]|escriv[aã]o?|comiss[aá]rio|perito|agente|servidor|investigador)\s+\(", r"\)", "g"),
    ("ner:H", "Nome (lista numerada)", r"^[ \t]*(?:\d+[.\):]|-|\*|•)\s+", r"[ \t]*$", "gm"),
    ("ner:I", "Nome (cargo policial)", r"\b(?:delegad[oa]|chefe|colega|servidor|investigador|escriv[aã]o?|comiss[aá]rio|perito|agente|policial|oficial|inspetor|subtenente|sargento|cabo|soldado)\s*:?\s+", r"\b", "gi"),
    ("ner:J", "Nome (campo de parte)", r"\b(?:[Pp]aciente|[Cc]liente|[Rr]espons[aá]vel|[Rr]equerente|[Rr]equerido|[Dd]etentor|[Pp]ortador|[Tt]itular|[Ii]nteressado|[Rr]epresentante\s+legal)\s*:?\s+", r"\b", "g"),
)
NER_NAME = _NAME
NER_C = rf"\b([{_UP}]{{2,}}(?:\s+(?:D[AEO]\s+)?[{_UP}]{{2,}}){{1,4}})\b"
NER_C_LABEL = "Nome (maiúsculas)"
NER_C_STOP = ("CPF", "RG", "CNH", "MASP", "REDS", "IPL", "BO", "CEP", "SUS", "NIS", "PIS", "TJMG", "PCMG", "CBMMG", "DETRAN", "SESP", "SJSP", "MG", "SP", "RJ", "DF", "BR", "SA", "ME", "EPP", "LTDA", "SS")
#: Category to vault key; other categories are their upper-case letters and digits.
KEYS = {"cpf": "CPF", "cnpj": "CNPJ", "rg": "RG", "cnh": "CNH", "masp": "MASP", "reds": "REDS", "process_number": "IPL", "plate": "PLACA", "phone": "TEL", "email": "EMAIL", "cep": "CEP", "health_data": "SAUDE", "name": "NOME", "date_of_birth": "NASC", "address": "END"}
# End of fixed values.

SCAN = (*DEFAULT, DATE_OF_BIRTH)


def by_id(pattern_id: str) -> Pattern | None:
    """A default pattern; secrets and custom patterns are not looked up."""
    return next((p for p in DEFAULT if p.id == pattern_id), None)
