"""Claims that a public answer should not make."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinela.functions.text import java_regex, spans

# Phrases, messages, points and known acronyms.
ABSOLUTE = (
    r"\b(com certeza|sem dúvida|indubitavelmente|incontestável|inequivocamente)\b",
    r"\b(sempre|nunca|todos os|nenhum)\b|(?<!\d)100%",
    r"\b(comprovadamente|cientificamente provado|fato consumado)\b",
)
FABRICATED = (
    r"\b(segundo (dados|pesquisas|estudos|estatísticas) (da|do|de))\b",
    r"\b(de acordo com (relatórios|levantamentos|números) (da|do|de))\b",
)
PROMISE = (
    r"\b(vamos (resolver|encaminhar|garantir|providenciar))\b",
    r"\b(isso será (encaminhado|resolvido|tratado) (pelo|pela|por))\b",
    r"\b(providências (serão|já foram) tomadas)\b",
)
PRIVACY_CONTEXT = "nome|processo|cpf|rg|masp|dado|privacidade|anonimat"
DEFINED = r"(\($|— $)"
POINTS = {"info": 2, "warning": 5, "error": 15, "critical": 30}
KNOWN_ACRONYMS = tuple(
    """CPF RG MASP REDS BO SINESP LGPD ANPD OAB CNJ CRM PIX INSS SUS STF STJ PCMG PMMG TJMG MPMG CGU TCU AGU
    AC AL AM AP BA CE DF ES GO MA MG MS MT PA PB PE PI PR RJ RN RO RR RS SC SE SP TO
    HIV AIDS UTI CTI UPA UBS CID SUS ANVISA CFM CFO CFF COREN
    CEO CTO CFO COO API URL SQL XML PDF CPD TI RH DP PJ PF ME MEI CNPJ CEP CNH FGTS CLT PIS NIS""".split()
)
# End of fixed values.
VIOLATIONS = "array<struct<level:string,category:string,message:string,matched:string>>"


def quoted(entity: str) -> str:
    return "".join("\\" + c if c in r".*+?^${}()|[]\\" else c for c in entity)


def _made(found: Column, level: str, category: str, message: str, about: str | None = None) -> Column:
    return F.transform(
        found,
        lambda m: F.struct(
            F.lit(level).alias("level"), F.lit(category).alias("category"),
            F.concat(F.lit(message + ': "'), F.lit(about) if about else m["matched"], F.lit('"')).alias("message"), m["matched"].alias("matched"),
        ),
    )


def acronyms(text: Column, known: Sequence[str] = KNOWN_ACRONYMS, defined: str = DEFINED) -> Column:
    """Upper-case words of 2-5 letters that are neither known nor being defined in place."""
    listed = F.array(*map(F.lit, known)) if known else F.array().cast("array<string>")
    before = lambda m: F.substring(text, F.greatest(m["start"] - 4, F.lit(1)), F.least(m["start"], F.lit(5)))
    return F.filter(spans(text, r"\b([A-Z]{2,5})\b"), lambda m: ~F.array_contains(listed, m["matched"]) & ~before(m).rlike(java_regex(defined)))


def violations(text: Column, blocked: Sequence[str] = (), known: Sequence[str] = KNOWN_ACRONYMS, absolute: Sequence[str] = ABSOLUTE, fabricated: Sequence[str] = FABRICATED, promise: Sequence[str] = PROMISE, context: str = PRIVACY_CONTEXT, defined: str = DEFINED) -> Column:
    parts = [_made(spans(text, quoted(e), "gi"), "critical", "blocked_entity", "Blocked entity mentioned", e) for e in blocked]
    parts.append(_made(acronyms(text, known, defined), "warning", "invented_acronym", "Possible invented acronym"))
    around = lambda m: F.substring(text, F.greatest(m["start"] - 39, F.lit(1)), m["end"] + 40 - F.greatest(m["start"] - 40, F.lit(0)))
    for p in absolute:
        kept = F.filter(spans(text, p, "gi"), lambda m: ~around(m).rlike(java_regex(context, "i")))
        parts.append(_made(kept, "warning", "absolute_claim", "Absolute claim without hedging"))
    parts += [_made(spans(text, p, "gi"), "error", "fabricated_data", "Possible fabricated data reference") for p in fabricated]
    parts += [_made(spans(text, p, "gi"), "error", "false_promise", "False promise of action") for p in promise]
    return F.coalesce(F.concat(*parts), F.array().cast(VIOLATIONS))


def score(found: Column, points: dict[str, int] | None = None) -> Column:
    p = POINTS | (points or {})
    worth = F.create_map(*[F.lit(x) for kv in p.items() for x in kv])
    return F.greatest(F.lit(0), F.lit(100) - F.aggregate(found, F.lit(0), lambda s, v: s + worth[v["level"]]))


def passed(found: Column) -> Column:
    return ~F.exists(found, lambda v: v["level"].isin("critical", "error"))


def report(rows: DataFrame, handler: Callable[[DataFrame], None], violations_col: str = "violations") -> DataFrame:
    """Hand the rows with a violation to ``handler`` (a sink), and give all rows back. In a stream,
    call it from foreachBatch."""
    handler(rows.where(F.size(violations_col) > 0))
    return rows


def filter_chunk(text: Column, blocked: Sequence[str]) -> Column:
    return F.regexp_replace(text, java_regex("|".join(map(quoted, blocked)), "gi"), "***") if blocked else text
