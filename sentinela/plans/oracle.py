"""DuckDB SQL of the queries, built independently of the column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from sentinela.operators import ethics as E
from sentinela.operators import patterns as P
from sentinela.operators.evaluate import TRACKED, TRACKED_BY_CATEGORY
from sentinela.operators.mask import BANNER, CRITICAL, DISCLOSURE, HIGH

SENTINEL = "chr(1)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _re2(source: str, flags: str) -> str:
    return q(("(?i)" if "i" in flags else "") + source)


def _parts(name: str, src: str, marked: str, columns: str) -> str:
    """Candidates between sentinels: doc_id, start, end, m."""
    return f"""{name} AS (
  SELECT doc_id, start, start + n AS "end", m, {columns}, before, after FROM (
    SELECT doc_id, text, i, part AS m, len(part) AS n, CAST(sum(len(part)) OVER (PARTITION BY doc_id ORDER BY i) - len(part) AS INTEGER) AS start,
           substr(text, CAST(sum(len(part)) OVER (PARTITION BY doc_id ORDER BY i) + 1 AS BIGINT), 1) AS after,
           right(substr(text, 1, CAST(sum(len(part)) OVER (PARTITION BY doc_id ORDER BY i) - len(part) AS BIGINT)), 5) AS before
    FROM (SELECT doc_id, text, unnest(parts) AS part, generate_subscripts(parts, 1) AS i
          FROM (SELECT doc_id, text, string_split({marked}, {SENTINEL}) AS parts FROM {src}) WHERE len(parts) > 1)
  ) WHERE i % 2 = 0)"""


def _whole(text: str, regex: str) -> str:
    return f"regexp_replace({text}, {regex}, {SENTINEL} || '\\0' || {SENTINEL}, 'g')"


def _grouped(before: str, group: str, after: str, flags: str) -> str:
    """The text with ``group`` between sentinels where it stands between ``before`` and ``after``."""
    lead = ("(?i)" if "i" in flags else "") + ("(?m)" if "m" in flags else "")
    return f"regexp_replace(text, {q(f'{lead}({before})({group})({after})')}, '\\1' || {SENTINEL} || '\\2' || {SENTINEL} || '\\3', 'g')"


def candidates(src: str, patterns: Sequence[P.Pattern], names: bool, ner: bool = False, by_key: bool = False) -> str:
    """CTEs that end in cand(doc_id, start, end, m, prio, id, category, label, mask). ``by_key``: the
    check-digit patterns, with their keys as category and their rules applied."""
    ctes, union = [], []
    for k, p in enumerate(patterns):
        source, where = p.source, "TRUE"
        marked = None
        if p.id == "placa_antiga":
            source = r"\b[A-Z]{3}[-\s]?\d{4}"
            where = "NOT regexp_matches(after, '[-0-9/]')" + ("" if by_key else r" AND NOT regexp_matches(m, '(?i)^(ISO|RFC|IEC|ITU|ICS|NBR)[-\s]?\d')")
        elif "(?<!\\d)" in source:  # digits may not touch it
            source = source.removeprefix(r"(?<!\d)").removesuffix(r"(?!\d)")
            marked, where = _grouped(r"^|\D", source, "", p.flags), "NOT regexp_matches(after, '[0-9]')"
        if by_key and p.validator:
            where += " AND " + checksum(p.validator, "m")
        tags = f"{k} AS prio, {q(p.id)} AS id, {q(p.key if by_key else p.kind)} AS category, {q(p.label)} AS label, {q(p.mask)} AS mask"
        ctes.append(_parts(f"c{k}", src, marked or _whole("text", _re2(source, p.flags)), tags))
        union.append(f"SELECT * FROM c{k} WHERE {where}")
    k = len(patterns)
    tags = lambda k, label: f"{k} AS prio, 'name' AS id, 'name' AS category, {q(label)} AS label, {q(P.NAME_MASK)} AS mask"
    if names:
        ctes.append(_parts(f"c{k}", src, _grouped(*P.NAME_RULE, ""), tags(k, P.NAME_LABEL)))
        union.append(f"SELECT * FROM c{k} WHERE len(m) > 3")
        k += 1
    if ner:
        for _, label, before, after, flags in P.NER_RULES:
            ctes.append(_parts(f"c{k}", src, _grouped(before, P.NER_NAME, after, flags), tags(k, label)))
            union.append(f"SELECT * FROM c{k} WHERE len(m) > 3")
            k += 1
        ctes.append(_parts(f"c{k}", src, _whole("text", q(P.NER_C)), tags(k, P.NER_C_LABEL)))
        words = "regexp_split_to_array(m, '\\s+')"
        union.append(f"SELECT * FROM c{k} WHERE len({words}) >= 2 AND NOT list_has_any({words}, [{', '.join(map(q, P.NER_C_STOP))}])")
    return ",\n".join(ctes) + ",\ncand AS (" + " UNION ALL ".join(union) + ")"


DISJOINT = """ordered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, prio) AS rn FROM cand
), walk AS (
  SELECT doc_id, rn, "end" AS last, TRUE AS keep FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.doc_id, o.rn, CASE WHEN o.start >= w.last THEN o."end" ELSE w.last END, o.start >= w.last
  FROM walk w JOIN ordered o ON o.doc_id = w.doc_id AND o.rn = w.rn + 1
), kept AS (
  SELECT o.* FROM ordered o JOIN walk w ON o.doc_id = w.doc_id AND o.rn = w.rn WHERE w.keep
)"""


def findings(corpus: str, patterns: Sequence[P.Pattern] = P.SCAN, names: bool = True, ner: bool = False, by_key: bool = False) -> str:
    """WITH clause that ends in kept; ``corpus`` is SQL for (doc_id, text)."""
    return f"WITH RECURSIVE corpus AS ({corpus}),\n{candidates('corpus', patterns, names, ner, by_key)},\n{DISJOINT}"


def spliced(expr: str) -> str:
    """(doc_id, out): the texts with each kept finding replaced by ``expr``."""
    return f""", pieces AS (
  SELECT k.doc_id, k.start, substr(c.text, coalesce(lag(k."end") OVER w, 0) + 1, k.start - coalesce(lag(k."end") OVER w, 0)) || {expr} AS piece
  FROM kept k JOIN corpus c ON c.doc_id = k.doc_id WINDOW w AS (PARTITION BY k.doc_id ORDER BY k.start)
), tails AS (SELECT doc_id, max("end") AS last FROM kept GROUP BY doc_id),
out AS (
  SELECT c.doc_id, coalesce(p.body, '') || substr(c.text, coalesce(t.last, 0) + 1) AS out
  FROM corpus c LEFT JOIN (SELECT doc_id, string_agg(piece, '' ORDER BY start) AS body FROM pieces GROUP BY doc_id) p ON p.doc_id = c.doc_id
  LEFT JOIN tails t ON t.doc_id = c.doc_id
)"""


def grades() -> str:
    lit = lambda xs: ", ".join(map(q, xs))
    return f""", grade AS (
  SELECT c.doc_id, c.text, count(k.doc_id) AS n,
         CASE WHEN bool_or(k.category IN ({lit(CRITICAL)})) THEN 'critical' WHEN bool_or(k.category IN ({lit(HIGH)})) THEN 'high'
              WHEN count(k.doc_id) > 3 THEN 'medium' ELSE 'low' END AS sensitivity
  FROM corpus c LEFT JOIN kept k ON k.doc_id = c.doc_id GROUP BY c.doc_id, c.text
), seen AS (
  SELECT doc_id, string_agg(label, ', ' ORDER BY first) AS labels FROM (SELECT doc_id, label, min(start) AS first FROM kept GROUP BY doc_id, label) GROUP BY doc_id
)"""


def mask_policy(corpus: str) -> str:
    return findings(corpus) + spliced("k.mask") + grades() + f"""
SELECT g.doc_id, o.out AS output, CASE WHEN g.sensitivity = 'critical' THEN {q(BANNER)} ELSE o.out END AS blocked_output, g.sensitivity,
       CASE WHEN g.n = 0 THEN '' ELSE {q(DISCLOSURE[0])} || s.labels || {q(DISCLOSURE[1])} END AS disclosure,
       CASE WHEN g.n = 0 THEN 'Nenhum dado sensível detectado.' ELSE 'Detectamos ' || g.n || ' dado(s) sensível(is): ' || s.labels || '.' END AS summary,
       g.n = 0 AS public_safe
FROM grade g JOIN out o ON o.doc_id = g.doc_id LEFT JOIN seen s ON s.doc_id = g.doc_id"""


def mask_partial(corpus: str, patterns: Sequence[P.Pattern] = P.DEFAULT, names: bool = False) -> str:
    d = "regexp_replace(k.m, '[^0-9]', '', 'g')"
    dom = "split_part(k.m, '@', 2)"
    tld = f"'.' || string_split({dom}, '.')[-1]"
    name = f"left({dom}, len({dom}) - len({tld}))"
    expr = f"""CASE WHEN k.id = 'cpf' AND len({d}) = 11 THEN '***.' || substr({d}, 4, 3) || '.' || substr({d}, 7, 3) || '-**'
      WHEN k.id = 'cnpj' AND len({d}) = 14 THEN '**.' || substr({d}, 3, 3) || '.' || substr({d}, 6, 3) || '/****-**'
      WHEN k.id = 'telefone' AND len({d}) >= 10 THEN '(' || left({d}, 2) || ') ****-' || right({d}, 4)
      WHEN k.id = 'email' THEN left(k.m, 1) || '***@' || left({name}, 1) || repeat('*', greatest(1, len({name}) - 1)) || {tld} ELSE k.mask END"""
    return findings(corpus, patterns, names) + spliced(expr) + "\nSELECT doc_id, out AS output FROM out"


def opaque(corpus: str, seed: str) -> str:
    return findings(corpus) + spliced(f"'[PII:' || upper(k.category) || ':' || left(sha256({q(seed + '|')} || k.m), 8) || ']'") + "\nSELECT doc_id, out AS tokenized FROM out"


def named(corpus: str, offline: bool = False) -> str:
    """The named vault; ``offline``: of the check-digit engine, whose categories are keys."""
    keys = " ".join(f"WHEN {q(c)} THEN {q(k)}" for c, k in P.KEYS.items())
    key = "category" if offline else f"CASE category {keys} ELSE regexp_replace(upper(category), '[^A-Z0-9]', '', 'g') END"
    return (findings(corpus, P.OFFLINE, False, by_key=True) if offline else findings(corpus)) + f""", lastly AS (
  SELECT doc_id, m, max(start) AS last_start, max_by(category, start) AS category FROM kept GROUP BY doc_id, m
), keyed AS (
  SELECT *, {key} AS key FROM lastly
)
SELECT doc_id, '[' || key || '_' || lpad(CAST(row_number() OVER (PARTITION BY doc_id, key ORDER BY last_start DESC) AS VARCHAR), 4, '0') || ']' AS token, m AS original FROM keyed"""


def violations(
    corpus: str, blocked: Sequence[str] = (), known: Sequence[str] = E.KNOWN_ACRONYMS, absolute: Sequence[str] = E.ABSOLUTE, fabricated: Sequence[str] = E.FABRICATED,
    promise: Sequence[str] = E.PROMISE, context: str = E.PRIVACY_CONTEXT,
) -> str:
    """Per document: counts by category, score, passed."""
    ctes, union = [], []
    listed = ", ".join(map(q, known)) or "''"
    for k, e in enumerate(blocked):
        ctes.append(_parts(f"b{k}", "corpus", _whole("text", q("(?i)" + E.quoted(e))), "'blocked_entity' AS category"))
        union.append(f"SELECT doc_id, category FROM b{k}")
    ctes.append(_parts("acr", "corpus", _whole("text", q(r"\b[A-Z]{2,5}\b")), "'invented_acronym' AS category"))
    union.append(f"SELECT doc_id, category FROM acr WHERE m NOT IN ({listed}) AND NOT regexp_matches(before, '(\\(|— )$')")
    for k, p in enumerate(absolute):
        bare = p.replace(r"(?<!\d)", "")
        ctes.append(_parts(f"a{k}", "corpus", _whole("text", q("(?i)" + bare)), "'absolute_claim' AS category"))
        union.append(
            f"""SELECT a.doc_id, category FROM a{k} a JOIN corpus c ON c.doc_id = a.doc_id WHERE NOT (m = '100%' AND regexp_matches(before, '[0-9]$'))
            AND NOT regexp_matches(substr(c.text, greatest(start - 39, 1), "end" + 40 - greatest(start - 40, 0)), {q('(?i)' + context)})"""
        )
    for name, group in (("fabricated_data", fabricated), ("false_promise", promise)):
        for k, p in enumerate(group):
            ctes.append(_parts(f"{name}{k}", "corpus", _whole("text", q("(?i)" + p)), f"{q(name)} AS category"))
            union.append(f"SELECT doc_id, category FROM {name}{k}")
    n = lambda c: f"count(*) FILTER (WHERE v.category = {q(c)})"
    warn, err, crit = f"({n('invented_acronym')} + {n('absolute_claim')})", f"({n('fabricated_data')} + {n('false_promise')})", n("blocked_entity")
    return f"""WITH corpus AS ({corpus}), {", ".join(ctes)}, v AS ({" UNION ALL ".join(union)})
SELECT c.doc_id, {n('blocked_entity')} AS n_blocked, {n('invented_acronym')} AS n_acronym, {n('absolute_claim')} AS n_absolute, {n('fabricated_data')} AS n_fabricated,
       {n('false_promise')} AS n_promise, CAST(greatest(0, 100 - 5 * {warn} - 15 * {err} - 30 * {crit}) AS INTEGER) AS score, {err} + {crit} = 0 AS passed
FROM corpus c LEFT JOIN v ON v.doc_id = c.doc_id GROUP BY c.doc_id"""


def inspected(corpus: str, blocked: Sequence[str] = (), critical_action: str = "block") -> str:
    """The facade: masking, claims, summary and verdict of each text."""
    base = findings(corpus) + spliced("k.mask") + grades() + ", kinds AS (SELECT doc_id, string_agg(category, ',' ORDER BY first) AS kinds FROM (SELECT doc_id, category, min(start) AS first FROM kept GROUP BY doc_id, category) GROUP BY doc_id)"
    base += " SELECT g.doc_id, g.text, o.out, g.n, g.sensitivity, k.kinds FROM grade g JOIN out o ON o.doc_id = g.doc_id LEFT JOIN kinds k ON k.doc_id = g.doc_id"
    names = "|".join(map(E.quoted, blocked))
    chunk = f"regexp_replace(f.out, {q('(?i)' + names)}, '***', 'g')" if blocked else "f.out"
    gone = "f.sensitivity = 'critical'" if critical_action == "block" else "FALSE"
    errors = "(v.n_blocked + v.n_fabricated + v.n_promise)"
    each = " || ".join(f"repeat({q(c + ', ')}, v.{n})" for c, n in (("blocked_entity", "n_blocked"), ("fabricated_data", "n_fabricated"), ("false_promise", "n_promise")))
    listed = f"rtrim({each}, ', ')"
    claims = f"CASE WHEN {errors} > 0 THEN 'Ethics: ' || {errors} || ' violation(s) (' || {listed} || ')' END"
    pii = "CASE WHEN f.n > 0 THEN 'PII: ' || f.n || ' finding(s) (' || f.sensitivity || ')' END"
    return f"""WITH f AS ({base}), v AS ({violations(corpus, blocked)}), r AS (
SELECT f.doc_id, f.text, f.kinds, CASE WHEN {gone} THEN {q(BANNER)} ELSE {chunk} END AS output, f.n = 0 AND v.passed AS safe, {gone} AS blocked, v.score, f.sensitivity,
       CAST(f.n AS INTEGER) AS n_findings, CAST(v.n_blocked + v.n_acronym + v.n_absolute + v.n_fabricated + v.n_promise AS INTEGER) AS n_violations, concat_ws(' | ', {claims}, {pii}) AS issues
FROM f JOIN v ON v.doc_id = f.doc_id)"""


INSPECTED = """
SELECT doc_id, output, safe, blocked, score, sensitivity, n_findings, CASE WHEN issues = '' THEN 'Output is clean — no violations found.' ELSE 'Issues found: ' || issues END AS summary FROM r"""


def checksum(kind: str, raw: str) -> str:
    """SQL predicate of a check-digit rule."""
    d = f"regexp_replace({raw}, '[^0-9]', '', 'g')"
    at = lambda i: f"CAST(substr(lpad({d}, 15, '0'), {i + 1} + 15 - len({d}), 1) AS INTEGER)"
    total = lambda ws, at0=0: "(" + " + ".join(f"{w} * {at(at0 + i)}" for i, w in enumerate(ws)) + ")"
    unlike = f"{d} <> repeat(left({d}, 1), len({d}))"
    if kind == "cpf":
        return f"(len({d}) = 11 AND {unlike} AND {total(range(10, 1, -1))} * 10 % 11 % 10 = {at(9)} AND {total(range(11, 1, -1))} * 10 % 11 % 10 = {at(10)})"
    if kind == "cnpj":
        w = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
        dv = lambda s: f"(CASE WHEN {s} % 11 < 2 THEN 0 ELSE 11 - {s} % 11 END)"
        return f"(len({d}) = 14 AND {unlike} AND {dv(total(w))} = {at(12)} AND {dv(total([6, *w]))} = {at(13)})"
    if kind == "cnh":
        s1, s2 = total(range(9, 0, -1)), total(range(1, 10))
        v2 = f"({s2} % 11 - CASE WHEN {s1} % 11 = 10 THEN 2 ELSE 0 END + CASE WHEN {s2} % 11 - CASE WHEN {s1} % 11 = 10 THEN 2 ELSE 0 END < 0 THEN 11 ELSE 0 END)"
        return f"(len({d}) = 11 AND {unlike} AND {s1} % 11 % 10 = {at(9)} AND CASE WHEN {v2} >= 10 THEN 0 ELSE {v2} END = {at(10)})"
    if kind == "pis":
        s = total([3, 2, 9, 8, 7, 6, 5, 4, 3, 2])
        return f"(len({d}) = 11 AND {unlike} AND CASE WHEN 11 - {s} % 11 >= 10 THEN 0 ELSE 11 - {s} % 11 END = {at(10)})"
    if kind == "cns":
        return f"(len({d}) = 15 AND {at(0)} >= 1 AND {total(range(15, 0, -1))} % 11 = 0)"
    return f"(len({d}) = 12 AND CAST(substr({d}, 9, 2) AS INTEGER) BETWEEN 1 AND 28 AND {total(range(2, 10))} % 11 % 10 = {at(10)} AND {total(range(7, 10), 8)} % 11 % 10 = {at(11)})"


def evaluated(rows: Sequence[tuple[int, str, Sequence[str]]]) -> str:
    """WITH clause that ends in m(pattern, tp, fp, fn, precision, recall, f1) and share."""
    texts = ", ".join(f"({i}, {q(t)})" for i, t, _ in rows)
    want = ", ".join(f"({i}, {q(p)})" for i, _, ps in rows for p in ps)
    back = " ".join(f"WHEN {q(c)} THEN {q(p)}" for c, p in TRACKED_BY_CATEGORY.items())
    return findings(f"SELECT * FROM (VALUES {texts}) t(doc_id, text)") + f""", want(doc_id, pattern) AS (VALUES {want}),
got AS (SELECT DISTINCT doc_id, pattern FROM (SELECT doc_id, CASE category {back} END AS pattern FROM kept) WHERE pattern IS NOT NULL),
kinds AS (
  SELECT coalesce(w.doc_id, g.doc_id) AS doc_id, coalesce(w.pattern, g.pattern) AS pattern, CASE WHEN g.doc_id IS NULL THEN 'fn' WHEN w.doc_id IS NULL THEN 'fp' ELSE 'tp' END AS kind
  FROM want w FULL JOIN got g ON w.doc_id = g.doc_id AND w.pattern = g.pattern
), n AS (
  SELECT pattern, count(*) FILTER (WHERE kind = 'tp') AS tp, count(*) FILTER (WHERE kind = 'fp') AS fp, count(*) FILTER (WHERE kind = 'fn') AS fn
  FROM kinds WHERE pattern IN ({", ".join(map(q, TRACKED))}) GROUP BY pattern
), pr AS (
  SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS precision, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS recall FROM n
), m AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr),
share AS (SELECT 100.0 * count(*) FILTER (WHERE b.doc_id IS NULL) / CAST(count(*) AS DOUBLE) AS perfect_pct
  FROM corpus c LEFT JOIN (SELECT DISTINCT doc_id FROM kinds WHERE kind <> 'tp') b ON b.doc_id = c.doc_id)"""
