"""DuckDB SQL for the operators that SQL can express.

SimHash and MinHash need hash functions that SQL lacks, the tokenizers'
merges, lattices and fitted models are no SQL, and which words a mix takes
is a seeded choice; those are tested against brute force.
"""

WORDS = r"list_filter(regexp_split_to_array(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _words(x: str) -> str:
    return WORDS.format(x)


OP5 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_words('text')} AS words FROM documents),
g AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM d, unnest(range(1, greatest(1, len(words) - 1))) AS t(i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + o) AS n FROM twice, (VALUES (0), (1), (2)) AS v(o) GROUP BY r),
l AS (SELECT r, k, line, {_words('line')} AS w FROM (SELECT r, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS line FROM d)),
judged AS (SELECT r, line, len(w) AS n,
  len(w) > 0 AND (
    NOT regexp_matches(line, '[.!?:;)\]"''”’»…。！？][\x20\x09-\x0D]*$')
    OR len(regexp_extract_all(line, '[!?#*$%&|<>~^=_@{{}}\\]')) > 0.3 * len(w)
    OR len(regexp_extract_all(line, '[|»›·•>]')) * 4 >= len(w)
    OR (len(w) <= 8 AND regexp_matches(line, '(?i)^[^a-z0-9]*(home|about us|contact us|log ?in|sign (in|up|out)|register|menu|next|previous|read more|back to top|share|tweet|skip to content|search|site ?map|follow us|startseite|über uns|kontakt|anmelden|abmelden|registrieren|weiterlesen|zurück zur|nach oben|teilen|impressum|folgen sie uns|accueil|à propos|contactez-nous|connexion|déconnexion|s''inscrire|précédent|lire la suite|haut de page|partager|rechercher|plan du site|suivez-nous|inicio|acerca de|contacto|iniciar sesión|cerrar sesión|registrarse|siguiente|leer más|volver arriba|compartir|buscar|mapa del sitio|síguenos)\b'))
    OR regexp_matches(lower(line), 'lorem ipsum|enable javascript|uses cookies|use cookies|cookie policy|privacy policy|terms of use|terms of service|all rights reserved|subscribe to|newsletter|click here|powered by|datenschutzerklärung|nutzungsbedingungen|alle rechte vorbehalten|verwendet cookies|hier klicken|politique de confidentialité|conditions d''utilisation|tous droits réservés|utilise des cookies|cliquez ici|abonnez-vous|política de privacidad|condiciones de uso|todos los derechos reservados|utiliza cookies|haga clic aquí|suscríbase')
  ) AS fails FROM l),
lines AS (SELECT r, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS dup, coalesce(sum(n) FILTER (fails), 0) AS lost FROM judged GROUP BY r),
f AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  dup::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, (len(words) - lost)::BIGINT AS n_kept_words
  FROM d JOIN lines USING (r) LEFT JOIN covered USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_kept_words >= 0.5 * n_words AS kept FROM f
"""


def _located(kind: str, pattern: str, options: str = "") -> str:
    """Rows (r, kind, s, e, v) of the matches of one pattern."""
    p = pattern.replace("'", "''")
    return (
        f"SELECT r, '{kind}' AS kind, s, s + length(v) AS e, v FROM (SELECT r, m[i] AS v, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT AS s "
        f"FROM (SELECT r, regexp_extract_all(text, '{p}', 0, '{options}') AS m, string_split_regex(text, '{p}', '{options}') AS g FROM d) , unnest(range(1, len(m) + 1)) AS t(i))"
    )


_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_VALUE = "regexp_extract(v, '{}', 2, 'i')".format(_ASSIGN.replace("'", "''"))

OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, chr(1)) AS owner FROM documents),
a AS (SELECT * FROM ({_located('assign', _ASSIGN, 'i')}) WHERE length({_VALUE}) >= 6),
b AS (SELECT *, 0 AS k FROM a UNION ALL SELECT *, 1 FROM ({_located('access', 'AKIA[A-Z0-9]{16,}')}) UNION ALL SELECT *, 2 FROM ({_located('hex', '[0-9a-f]{24,}')})),
cand AS (SELECT r, e - length({_VALUE}) AS s, e, {_VALUE} AS v FROM a UNION SELECT r, s, e, v FROM b WHERE k > 0 UNION SELECT r, s, e, v FROM ({_located('run', '[A-Za-z0-9+/_=-]{20,}')})),
good AS (SELECT * FROM cand WHERE length(v) >= 16 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
  AND NOT regexp_matches(v, '(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|00000000|12345678') AND len(list_distinct(string_split(v, ''))) >= 8),
owned AS (SELECT v FROM good JOIN d USING (r) GROUP BY v HAVING count(DISTINCT owner) <= 3 AND count(DISTINCT coalesce(doc_id::VARCHAR, '')) <= 10 * count(DISTINCT owner)),
spans AS (SELECT r, s, k, kind, e FROM b UNION ALL SELECT r, s, 3, 'live', e FROM good SEMI JOIN owned USING (v)),
o AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (k < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o USING (r)
"""

ORACLES: dict[str, str] = {"op5_quality_rules": OP5, "op8_secret_scan": OP8}
