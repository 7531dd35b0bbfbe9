"""The SQL that gives the rows of the registered core queries, for DuckDB over the same tables.

Written on its own from the meaning of each operator; where SQL has no counterpart (greedy pairing, lattice parsing of
units, note repair with look-around) there is none, and the query is tested against brute force instead.
"""

from __future__ import annotations

from coverline.functions import fixed
from coverline.functions.lexicon import DEFAULT

# White space and digits as the engine's expressions understand them, for RE2.
_WS = r"\s\x0b\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(p: str) -> str:
    r"""A pattern with \s and \d as Unicode classes, as an SQL literal (classes in brackets are spelled out by the caller)."""
    return q(p.replace(r"\s", f"[{_WS}]").replace(r"[\d", r"[\p{Nd}").replace(r"\d", r"\p{Nd}"))


def t(c: str) -> str:
    return f"coalesce({c}, '')"


def strip(e: str) -> str:
    return f"regexp_replace({e}, {q(f'^[{_WS}]+|[{_WS}]+$')}, '', 'g')"


def clean(e: str) -> str:
    return strip(f"regexp_replace({e}, '[ \t\n]+', ' ', 'g')")


def squeeze(e: str) -> str:
    return f"regexp_replace({e}, {q(f'[{_WS}]+')}, '', 'g')"


def won(e: str) -> str:
    scaled = f"nullif(regexp_extract({e}, {rx(r'([\d,]*\d[\d,]*)\s*만\s*원')}, 1), '')"
    plain = f"nullif(regexp_extract({e}, {rx(r',*(\d[\d,]*)')}, 1), '')"
    number = lambda x: f"try_cast(replace({x}, ',', '') AS BIGINT)"
    return f"coalesce({number(scaled)} * 10000, nullif({number(plain)}, 0))"


def short_condition(e: str) -> str:
    n = strip(f"regexp_replace({e}, {q(f'[{_WS}]+')}, ' ', 'g')")
    period = f"replace(regexp_extract({n}, {rx(fixed.PERIOD_SHORT)}, 0), ' ', '')"
    fixed_up = f"CASE WHEN {period} LIKE '%후' AND {period} NOT LIKE '%이후' THEN regexp_replace({period}, '후$', '이후') ELSE {period} END"
    head = f"regexp_replace(substr({n}, 1, 15), {q(f'[{_WS}]+$')}, '')"
    return f"CASE WHEN {period} <> '' THEN {fixed_up} ELSE {head} || CASE WHEN length({n}) > 15 THEN '…' ELSE '' END END"


def limit_unit(e: str) -> str:
    s = squeeze(e)
    u = f"regexp_extract({s}, '[0-9]+(년|회)', 1)"
    return f"CASE WHEN {u} = '' THEN NULL WHEN {u} = '년' THEN '년' WHEN contains({s}, '최초') THEN '최초_회' WHEN contains({s}, '연간') OR contains({s}, '매년') THEN '연간_회' ELSE '회' END"


def limit_n(e: str) -> str:
    return f"try_cast(nullif(regexp_extract({squeeze(e)}, '([0-9]+)(?:년|회)', 1), '') AS BIGINT)"


def match_text(e: str) -> str:
    return f"regexp_replace(regexp_replace({e}, '\\([^)]*\\)', '', 'g'), {q(f'[·∙/,{_WS}]+')}, '', 'g')"


def bare(e: str) -> str:
    return f"regexp_replace({e}, '(?:{'|'.join(fixed.TYPE_SUFFIXES)})$', '')"


def slot(e: str, name: str) -> str:
    order = sorted(enumerate(DEFAULT.entries(name)), key=lambda x: (-len(x[1][0]), x[0]))
    table = "[" + ", ".join(f"{{'s': {q(s)}, 'l': {q(label)}}}" for _, (s, label) in order) + "]"
    return f"coalesce(list_filter({table}, lambda e: contains({e}, e.s))[1].l, '')"


def masked(e: str) -> str:
    words = sorted((s for s, _ in DEFAULT.entries("action")), key=len, reverse=True)
    return f"list_reduce(list_prepend({e}, [{', '.join(map(q, words))}]), lambda acc, w: replace(acc, w, repeat(' ', length(w))))"


def keyed(names: str) -> str:
    """A query of (benefit_name, m, key, action) from a query of distinct benefit_name."""
    actions = "[" + ", ".join(map(q, DEFAULT.labels("action"))) + "]"
    return f"""
    SELECT benefit_name, m, key, coalesce(list_filter(string_split(key, '|'), lambda p: list_contains({actions}, p))[-1], '') AS action FROM (
      SELECT benefit_name, m, CASE WHEN m = '' THEN '' WHEN len(parts) = 0 THEN m ELSE array_to_string(parts, '|') END AS key FROM (
        SELECT benefit_name, m, list_filter([{slot('b', 'condition')}, {slot('x', 'disease')}, CASE WHEN {slot('b', 'action')} <> '' THEN {slot('b', 'action')} ELSE {slot('m', 'action')} END], lambda p: p <> '') AS parts FROM (
          SELECT benefit_name, m, b, {masked('b')} AS x FROM (SELECT benefit_name, m, {bare('m')} AS b FROM (SELECT benefit_name, {match_text('benefit_name')} AS m FROM ({names})))
        )))"""


NAMES = "SELECT DISTINCT benefit_name FROM summary_rows WHERE coalesce(benefit_name, '') <> ''"


def first_of(e: str, lists, otherwise: str) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains({e}, {q(w)})" for w in words) + f" THEN {q(label)}" for label, words in lists)
    return f"CASE {whens} ELSE {q(otherwise)} END"


# Fixed values, written down for the check on their own: kind of insurance: category label keyword/keyword/...
CATEGORY_WORDS = {
    "암보험": """
        diagnosis 진단 암으로 진단/악성신생물/진단확정/고액암/특정암/제자리암/상피내암/경계성종양/갑상선암진단/기타피부암진단/유방암진단/전립선암진단
        surgery 수술 암수술/암으로 수술/로봇수술/다빈치/레보아이/직접적인 목적으로 수술/절제/적출
        treatment 치료 항암약물치료/항암방사선치료/암직접치료/직접치료급여금/암의 직접적인 치료/항암/방사선치료/면역치료
        hospitalization 입원 입원/입원일당/입원급여금
        living_benefit 생활비 생활자금/암생활자금/생존한 경우/매월/매년 진단확정일
        death 사망 사망/사망보험금/암으로 사망/암사망
        premium_waiver 납입면제 보험료 납입을 면제/납입면제
        examination 검사 검사비/검사비용/검사자금/PET/NGS/유전자패널/바늘생검/조직병리/양전자단층/PSMA/주요검사/기타검사
        icu 중환자실 중환자실
        consultation 다학제진료 다학제
        supportive_care 지지요법 통증완화/항구토/영양치료/집중영양/재활치료/특정재활
        disability 장해 장해보험금/장해급여금/장해자금/장해분류표/질병장해
        outpatient 통원 통원/외래
        nursing_hospital 요양병원 요양병원입원/요양병원암입원
        male_infertility 기타 남성난임/정자채취""",
    "치매보험": """
        diagnosis 진단 치매로 진단/알츠하이머/CDR/경증치매/중증치매/치매진단/뇌혈관성치매/치매등급
        nursing 간병 장기요양/요양병원/간병비/간병인/노인장기요양보험/요양급여
        living_benefit 생활비 생활자금/생활비/매월/생존한 경우
        premium_waiver 납입면제 보험료 납입을 면제/납입면제""",
    "치아보험": """
        prosthetics 보철 임플란트/브리지/틀니/보철/크라운
        treatment 치료 충치/레진/인레이/신경치료/치주/스케일링/치료
        accident 사고 사고/파절/외상""",
    "뇌심장보험": """
        diagnosis 진단 뇌졸중/뇌경색/뇌출혈/급성심근경색/협심증/심부전/부정맥/관상동맥
        surgery 수술 수술/스텐트/관상동맥우회
        hospitalization 입원 입원/입원일당""",
    "default": """
        diagnosis 진단 진단확정/진단보험금/진단자금
        surgery 수술 수술/수술보험금/수술자금
        hospitalization 입원 입원/입원일당/입원보험금
        death 사망 사망/사망보험금
        premium_waiver 납입면제 납입면제/보험료 면제
        examination 검사 검사비/검사비용/검사자금
        disability 장해 장해보험금/장해급여금/장해자금/장해분류표""",
}


def category(e: str, kind: str, what: int) -> str:
    def section(name):
        rows = [(c, label, words.split("/")) for c, label, words in (x.strip().split(" ", 2) for x in CATEGORY_WORDS[name].strip().split("\n"))]
        return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({e}, {q(w)})" for w in r[2]) + f" THEN {q(r[what])}" for r in rows) + " END"

    by_kind = "CASE " + " ".join(f"WHEN {kind} = {q(k)} THEN {section(k)}" for k in CATEGORY_WORDS if k != "default") + " END"
    return f"coalesce({by_kind}, {section('default')})"


def insurance_type(product: str, source: str) -> str:
    return first_of(f"lower({t(product)} || ' ' || {t(source)})", fixed.INSURANCE_TYPES, "default")


def document_type(name: str, text: str) -> str:
    s, u = (f"len(regexp_extract_all({text}, {q(p.replace(chr(92) + 's', '[ ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'x0b' + chr(92) + 'f' + chr(92) + 'r]'))}))" for p in (fixed.SUMMARY_TEXT, fixed.TERMS_TEXT))
    return f"CASE WHEN regexp_matches({name}, {q(fixed.SUMMARY_NAME)}) THEN 'summary' WHEN regexp_matches({name}, {q(fixed.TERMS_NAME)}) THEN 'terms' WHEN {s} > {u} AND {s} >= 2 THEN 'summary' WHEN {u} > {s} AND {u} >= 2 THEN 'terms' WHEN {s} > 0 THEN 'summary' WHEN {u} > 0 THEN 'terms' ELSE 'unknown' END"


OUR, COMP = "'해솔빛화재'", "'달무리화재'"
KEYFIELDS = "concat_ws('|', coalesce(insurer,''), coalesce(product_name,''), coalesce(contract_name,''), coalesce(benefit_name,''), coalesce(amount,''), coalesce(amount_condition,''), substr(coalesce(trigger,''),1,200), coalesce(source_pdf,''))"
GROUPS = "coalesce(insurer,'') AS insurer, coalesce(product_name,'') AS product_name, coalesce(contract_name,'') AS contract_name, coalesce(benefit_name,'') AS benefit_name, coalesce(renewal_type,'') AS renewal_type, coalesce(coverage_limit,'') AS coverage_limit"
GCOLS = "insurer, product_name, contract_name, benefit_name, renewal_type, coverage_limit"
COLLAPSED = f"""
  SELECT {GCOLS}, min(row_id) AS ord, arg_min(amount, row_id) AS amount, arg_min(amount_condition, row_id) AS amount_condition,
         coalesce(arg_min(trigger, row_id) FILTER (trigger <> ''), '') AS trigger, count(DISTINCT trigger) FILTER (trigger <> '') AS n_triggers,
         count(DISTINCT (amount, amount_condition, substr(trigger, 1, 80))) AS n_all, count(*) AS detail_row_count
  FROM (SELECT row_id, {GROUPS}, coalesce(amount,'') AS amount, coalesce(amount_condition,'') AS amount_condition, coalesce(trigger,'') AS trigger FROM summary_rows)
  GROUP BY ALL"""


def sides() -> str:
    return f"""WITH c AS ({COLLAPSED}), k AS ({keyed("SELECT DISTINCT benefit_name FROM (SELECT coalesce(benefit_name, '') AS benefit_name FROM summary_rows)")}),
    n AS (SELECT k.key, count(*) FILTER (insurer = {OUR}) AS o, count(*) FILTER (insurer = {COMP}) AS c FROM c JOIN k USING (benefit_name) WHERE insurer IN ({OUR}, {COMP}) GROUP BY k.key)"""


def neighbours() -> str:
    cols = ("amount", "reduction_note", "coverage_limit", "amount_condition")
    return "SELECT row_id, " + ", ".join(f"coalesce({c}, '') AS {c}, coalesce(lead({c}) OVER w, '') AS next_{c}" for c in cols) + " FROM summary_rows WINDOW w AS (PARTITION BY artifact_id ORDER BY row_id)"


def verdict(kind: str, c: str) -> str:
    a, b = c, f"next_{c}"
    base = f"CASE WHEN {a} = '' AND {b} = '' THEN '비교불가' "
    if kind in ("numeric", "limit_numeric"):
        base += f"WHEN {a} = '' THEN '타사우위' WHEN {b} = '' THEN '당사우위' "
    elif kind != "none_is_better":
        base += f"WHEN {a} = '' OR {b} = '' THEN '비교불가' "
    same = f"CASE WHEN {squeeze(a)} = {squeeze(b)} THEN '동일' ELSE '비교불가' END"
    larger = lambda x, y, s=">": f"WHEN {x} = {y} THEN '동일' WHEN {x} {s} {y} THEN '당사우위' ELSE '타사우위' END"
    if kind == "numeric":
        return base + f"WHEN {won(a)} IS NULL OR {won(b)} IS NULL THEN CASE WHEN {strip(a)} = {strip(b)} THEN '동일' ELSE '비교불가' END {larger(won(a), won(b))}"
    if kind == "rank":
        items = ["매월", "매년", "매회"]
        rank = lambda e: "CASE " + " ".join(f"WHEN {squeeze(e)} = '{i}' THEN {k}" for k, i in enumerate(items)) + " " + " ".join(f"WHEN contains({squeeze(e)}, '{i}') OR contains('{i}', {squeeze(e)}) THEN {k}" for k, i in enumerate(items)) + " END"
        return base + f"WHEN {rank(a)} IS NULL OR {rank(b)} IS NULL THEN CASE WHEN {strip(a)} = {strip(b)} THEN '동일' ELSE '비교불가' END {larger(rank(a), rank(b))}"
    if kind == "limit_numeric":
        return base + f"WHEN {limit_unit(a)} IS NULL OR {limit_unit(b)} IS NULL THEN {same} WHEN {limit_unit(a)} <> {limit_unit(b)} THEN '비교불가' {larger(limit_n(a), limit_n(b))}"
    if kind == "none_is_better":
        no = lambda e: f"{strip(e)} IN ({', '.join(map(q, fixed.NO_VALUE))})"
        return base + f"WHEN {no(a)} AND {no(b)} THEN '동일' WHEN {no(a)} THEN '당사우위' WHEN {no(b)} THEN '타사우위' WHEN {won(a)} IS NULL OR {won(b)} IS NULL THEN {same} {larger(won(a), won(b), '<')}"
    return base + f"WHEN {squeeze(a)} = {squeeze(b)} THEN '동일' ELSE '표시' END"


def names_split() -> str:
    whole = clean(r"regexp_replace(regexp_replace(coalesce(benefit_name,''), '([가-힣A-Za-z0-9)])\n([가-힣A-Za-z0-9(])', '\1\2', 'g'), '([가-힣A-Za-z0-9)])\n([가-힣A-Za-z0-9(])', '\1\2', 'g')")
    parts = f"list_filter(list_transform(regexp_split_to_array(w, {q(f'[{_WS}]*[∙·][{_WS}]*')}), lambda p: {strip('p')}), lambda p: length(p) >= 2 AND NOT regexp_matches(p, {q(chr(94) + '[' + _WS + chr(92) + 'p{Nd}]+$')}))"
    return f"SELECT row_id, pos - 1 AS pos, l[pos] AS name FROM (SELECT row_id, l, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT row_id, CASE WHEN len(k) > 0 THEN k WHEN w <> '' THEN [w] ELSE [] END AS l FROM (SELECT row_id, w, {parts} AS k FROM (SELECT row_id, {whole} AS w FROM summary_rows))))"


PRINTED = """
  SELECT artifact_id, row_id, n, CASE WHEN again THEN '' ELSE name END AS name, CASE WHEN again THEN '' ELSE cause END AS cause, sum FROM (
    SELECT artifact_id, row_id, row_number() OVER w AS n, coalesce(benefit_name,'') AS name, coalesce(trigger,'') AS cause, coalesce(amount,'') AS sum,
      coalesce(coalesce(benefit_name,'') = coalesce(lag(benefit_name) OVER w, '') AND coalesce(trigger,'') = coalesce(lag(trigger) OVER w, '') AND row_number() OVER w > 1, false) AS again
    FROM summary_rows WHERE artifact_id IS NOT NULL WINDOW w AS (PARTITION BY artifact_id ORDER BY row_id))"""
BLOCKS = f"""
  SELECT artifact_id AS doc_id, CAST(floor((n - 1) / 20) AS BIGINT) AS page_idx, n * 3 + k AS block_no, x0, CAST((n - 1) % 20 * 30 + 100 + k AS DOUBLE) AS y0, text
  FROM (SELECT artifact_id, n, unnest([0, 1, 2]) AS k, unnest([50.0, 200.0, 400.0]) AS x0, unnest([name, cause, sum]) AS text FROM ({PRINTED})) WHERE text <> ''"""
RAW = f"SELECT CASE WHEN insurer = {OUR} THEN 'our' ELSE 'comp' END AS side, * FROM summary_rows WHERE insurer IN ({OUR}, {COMP})"
FIELDS = ["benefit_name", "amount", "amount_condition", "trigger", "coverage_limit", "waiting_period", "reduction_note"]


def sql() -> dict[str, str]:
    """SQL by query."""
    body = f"(SELECT doc_id, n, {clean('name')} AS name, {clean('cause')} AS cause, {clean('sum')} AS sum FROM (SELECT artifact_id AS doc_id, * FROM ({PRINTED})))"
    opened = f"(SELECT *, sum(CASE WHEN name <> '' OR cause <> '' THEN 1 ELSE 0 END) OVER u AS g, last_value(nullif(name,'') IGNORE NULLS) OVER u AS fn, last_value(nullif(cause,'') IGNORE NULLS) OVER u AS ft FROM {body} WINDOW u AS (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING))"
    table_benefits = f"SELECT doc_id, CAST(g AS BIGINT) AS benefit_no, coalesce(arg_min(coalesce(fn,''), n), '') AS name, coalesce(arg_min(coalesce(ft,''), n), '') AS trigger, count(*) FILTER (sum <> '') AS n_amounts FROM {opened} WHERE g > 0 GROUP BY doc_id, g"
    valid = rf"name <> '' AND NOT regexp_matches(name, {rx(r'^■|^주\s*\)|급\s*부\s*명|지\s*급\s*사\s*유|지\s*급\s*금\s*액')}) AND NOT (starts_with(name, '보험기간 중 피보험자') AND n_amounts = 0)"
    evid = " UNION ALL ".join(f"SELECT side, row_id AS ord, {i} AS field_ord, '{f}' AS field, coalesce(benefit_name,'') AS benefit, coalesce({f},'') AS value FROM r WHERE coalesce({f},'') <> ''" for i, f in enumerate(FIELDS))
    kind = insurance_type("product_name", "source_pdf")
    wait = rx(fixed.WAITING)
    out = {
        "clean_whitespace": f"SELECT row_id, {clean(t('trigger'))} AS cleaned, {squeeze(t('benefit_name'))} AS squeezed FROM summary_rows",
        "joined_names": r"SELECT row_id, " + clean(r"regexp_replace(regexp_replace(coalesce(trigger,''), '([가-힣A-Za-z0-9)])\n([가-힣A-Za-z0-9(])', '\1\2', 'g'), '([가-힣A-Za-z0-9)])\n([가-힣A-Za-z0-9(])', '\1\2', 'g')") + " AS joined FROM summary_rows",
        "letter_spacing": f"SELECT row_id, regexp_replace(regexp_replace({t('contract_name')}, {q(f'([가-힣])[{_WS}]+([가-힣])')}, '\\1\\2', 'g'), {q(f'([가-힣])[{_WS}]+([가-힣])')}, '\\1\\2', 'g') AS unspaced FROM summary_rows",
        "split_names": names_split(),
        "extracted_terms": f"SELECT row_id, regexp_extract({t('contract_name')}, '갱신형|비갱신형', 0) AS renewal, substr(regexp_extract({t('trigger')} || ' ' || {t('notes_summary')}, {wait}, 0), 1, 80) AS waiting, regexp_extract({t('trigger')}, {rx(fixed.LIMIT)}, 0) AS cov_limit, regexp_extract('(기준 : 특약가입금액 ' || {t('amount')} || ')', {rx(fixed.REFERENCE_AMOUNT)}, 1) AS reference FROM summary_rows",
        "amount_won": f"SELECT row_id, {won(t('amount'))} AS won FROM summary_rows",
        "limits": f"SELECT row_id, {limit_unit('x')} AS unit, {limit_n('x')} AS n FROM (SELECT row_id, coalesce(nullif(coverage_limit, ''), trigger, '') AS x FROM summary_rows)",
        "short_conditions": f"SELECT entry_id, {short_condition(t('condition'))} AS short FROM amount_entries",
        "amount_similarity": f"SELECT row_id, round(CASE WHEN a = b THEN 1.0 WHEN a = '' OR b = '' THEN 0.0 ELSE len(list_intersect(x, y)) / greatest(len(x), len(y)) END, 9) AS similarity FROM (SELECT row_id, amount AS a, next_amount AS b, list_distinct(string_split(amount, '')) AS x, list_distinct(string_split(next_amount, '')) AS y FROM ({neighbours()}))",
        "slot_verdicts": f"SELECT row_id, {verdict('numeric', 'amount')} AS amount_v, {verdict('limit_numeric', 'coverage_limit')} AS limit_v, {verdict('none_is_better', 'reduction_note')} AS reduction_v, {verdict('display_only', 'amount_condition')} AS condition_v, {verdict('rank', 'amount_condition')} AS rank_v FROM ({neighbours()})",
        "match_texts": f"SELECT benefit_name, m AS match_text, {bare('m')} AS bare FROM (SELECT benefit_name, {match_text('benefit_name')} AS m FROM ({NAMES}))",
        "canonical_keys": f"SELECT benefit_name, key, action, key = m AND NOT contains(key, '|') AS raw FROM ({keyed(NAMES)})",
        "canonical_key_counts": f"SELECT k.key, count(*) AS n FROM summary_rows JOIN ({keyed(NAMES)}) k USING (benefit_name) GROUP BY k.key",
        "masked_names": f"SELECT benefit_name, {masked('m')} AS masked, {slot('m', 'action')} AS action FROM (SELECT benefit_name, {match_text('benefit_name')} AS m FROM ({NAMES}))",
        "document_types": f"SELECT doc_id, by_text, by_name, CASE WHEN by_text = 'unknown' THEN 'terms' ELSE by_text END AS resolved FROM (SELECT doc_id, {document_type(q(''), t('text'))} AS by_text, {document_type('fn', t('text'))} AS by_name FROM (SELECT *, 'd' || doc_id || CASE WHEN doc_type = 'terms' THEN '_약관.pdf' ELSE '_S.pdf' END AS fn FROM documents))",
        "insurance_types": f"SELECT contract_id, {kind} AS kind, {first_of(t('contract_name'), fixed.CANCER_CLASSES, '')} AS cancer FROM contracts",
        "benefit_categories": f"SELECT row_id, coalesce({category('bn', 'kind', 0)}, CASE WHEN tr <> '' THEN {category('nt', 'kind', 0)} END, 'other') AS category, coalesce({category('bn', 'kind', 1)}, CASE WHEN tr <> '' THEN {category('nt', 'kind', 1)} END, '기타') AS label FROM (SELECT row_id, {t('benefit_name')} AS bn, {t('trigger')} AS tr, {t('benefit_name')} || ' ' || {t('trigger')} AS nt, {kind} AS kind FROM summary_rows)",
        "categories_filled": f"SELECT row_id, CASE WHEN cat <> '' THEN cat ELSE coalesce({category('bn', 'kind', 0)}, CASE WHEN tr <> '' THEN {category('nt', 'kind', 0)} END, 'other') END AS benefit_category, CASE WHEN cat <> '' THEN ko ELSE coalesce({category('bn', 'kind', 1)}, CASE WHEN tr <> '' THEN {category('nt', 'kind', 1)} END, '기타') END AS benefit_category_ko FROM (SELECT row_id, CASE WHEN row_id % 3 = 0 THEN '' ELSE coalesce(benefit_category, '') END AS cat, benefit_category_ko AS ko, {t('benefit_name')} AS bn, {t('trigger')} AS tr, {t('benefit_name')} || ' ' || {t('trigger')} AS nt, {kind} AS kind FROM summary_rows)",
        "upload_types": f"SELECT DISTINCT '/in/' || {t('source_pdf')} AS path, {t('source_pdf')} AS filename, {document_type(t('source_pdf'), q(''))} AS doc_type, CASE {document_type(t('source_pdf'), q(''))} WHEN 'summary' THEN '상품요약서' WHEN 'terms' THEN '약관' ELSE '알 수 없음' END AS label, true AS is_hint_only FROM summary_rows",
        "other_ratio": "SELECT n_rows, n_other, round(n_other / n_rows, 9) AS share, n_other / n_rows > 0.05 AS alert FROM (SELECT count(*) AS n_rows, count(*) FILTER (benefit_category = 'other') AS n_other FROM summary_rows)",
        "category_distribution": "SELECT category, n, first_ord, round(n / sum(n) OVER (), 9) AS share FROM (SELECT coalesce(benefit_category, '') AS category, count(*) AS n, min(row_id) AS first_ord FROM summary_rows GROUP BY 1)",
        "unmapped_names": f"SELECT benefit_name, count(*) AS n_rows, arg_max(coalesce(benefit_category, ''), row_id) AS category FROM summary_rows JOIN ({keyed(NAMES)}) k USING (benefit_name) WHERE k.key = k.m AND NOT contains(k.key, '|') GROUP BY benefit_name",
        "names_without_action": f"SELECT benefit_name, count(*) AS n_rows, any_value(k.key) AS key FROM summary_rows JOIN ({keyed(NAMES)}) k USING (benefit_name) WHERE NOT (k.key = k.m AND NOT contains(k.key, '|')) AND k.action = '' GROUP BY benefit_name",
        "solo_keys": f"SELECT k.key, min(insurer) AS insurer, count(*) AS n_rows FROM summary_rows JOIN ({keyed(NAMES)}) k USING (benefit_name) WHERE coalesce(insurer, '') <> '' GROUP BY k.key HAVING count(DISTINCT insurer) = 1",
        "dedupe_keys": f"SELECT row_id, substr(md5({KEYFIELDS}), 1, 16) AS new_key, substr(md5({KEYFIELDS}), 1, 16) = coalesce(dedupe_key, '') AS fresh FROM summary_rows",
        "catalog_all": f"SELECT k AS dedupe_key, arg_min(row_id, (src, row_id)) AS ord, min(src) AS src FROM (SELECT CASE WHEN coalesce(dedupe_key,'') = '' THEN substr(md5({KEYFIELDS}), 1, 16) ELSE dedupe_key END AS k, row_id, unnest(CASE WHEN coalesce(dedupe_key,'') = '' THEN [0, 1] ELSE [1] END) AS src FROM summary_rows) GROUP BY k",
        "catalog_upsert": "WITH r AS (SELECT row_id, dedupe_key, coalesce(batch_no > 6, false) AS late FROM summary_rows LEFT JOIN artifacts USING (artifact_id) WHERE coalesce(dedupe_key, '') <> '') SELECT row_id, dedupe_key FROM r WHERE late OR NOT EXISTS (SELECT 1 FROM r l WHERE l.late AND l.dedupe_key = r.dedupe_key)",
        "unseen_artifacts": "SELECT artifact_id, batch_no FROM artifacts a WHERE batch_no > 6 AND NOT EXISTS (SELECT 1 FROM artifacts b WHERE b.batch_no <= 6 AND b.file_hash <> '' AND b.file_hash = a.file_hash)",
        "first_uploads": "SELECT artifact_id, file_hash FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY received_at NULLS FIRST, artifact_id) AS n FROM artifacts) WHERE coalesce(file_hash, '') = '' OR n = 1",
        "fingerprints": "SELECT doc_id, substr(sha256(text), 1, 32) AS whole, CASE WHEN octet_length(encode(text)) <= 65536 THEN substr(sha256(text), 1, 32) ELSE substr(sha256(encode(text)[1:65536]), 1, 32) END AS short FROM documents WHERE text IS NOT NULL",
        "companies": "SELECT insurer, min(row_id) AS first_ord FROM summary_rows WHERE coalesce(insurer, '') <> '' GROUP BY insurer",
        "context_rows": f"SELECT row_id, product_name, benefit_name FROM summary_rows WHERE insurer = {OUR}",
        "product_choices": "SELECT DISTINCT product_name FROM summary_rows WHERE coalesce(product_name, '') <> ''",
        "dashboard_counts": "SELECT count(DISTINCT insurer) AS companies, count(DISTINCT product_name) AS products, count(*) AS n_rows FROM summary_rows",
        "column_fill": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", coalesce(bool_or(coalesce({c}, '') <> ''), false) AS filled FROM summary_rows" for c in ("trigger", "slots", "waiting_period", "exclusions", "terms_reference")),
        "artifact_meta": "SELECT insurer, product_name, count(*) AS row_count, min(row_id) AS first_row FROM summary_rows WHERE insurer IS NOT NULL GROUP BY ALL",
        "comparison_collapse": f"SELECT * EXCLUDE (n_all), CASE WHEN n_all > 1 THEN n_all ELSE 0 END AS n_entries FROM ({COLLAPSED})",
        "match_counts_by_key": sides() + " SELECT key, least(o, c) AS matched, greatest(o - c, 0) AS our_only, greatest(c - o, 0) AS comp_only FROM n",
        "match_summary": sides() + " SELECT CAST(coalesce(sum(least(o, c)), 0) AS BIGINT) AS matched, CAST(coalesce(sum(greatest(o - c, 0)), 0) AS BIGINT) AS our_only, CAST(coalesce(sum(greatest(c - o, 0)), 0) AS BIGINT) AS comp_only FROM n",
        "evidence": f"WITH r AS ({RAW}) {evid}",
        "evidence_numbers": f"WITH r AS ({RAW}), e AS ({evid}) SELECT row_number() OVER (ORDER BY side DESC, ord, field_ord) AS evidence_no, side, field, benefit, substr(value, 1, 200) AS value FROM e",
        "names_alone": f"WITH r AS ({RAW}) SELECT side, benefit_name, min(row_id) AS ord FROM r WHERE benefit_name IS NOT NULL GROUP BY side, benefit_name HAVING NOT EXISTS (SELECT 1 FROM r x WHERE x.side <> r.side AND x.benefit_name = r.benefit_name)",
        "amounts_differ": f"WITH r AS ({RAW}), l AS (SELECT side, benefit_name, arg_max(coalesce(amount, ''), row_id) AS a FROM r WHERE benefit_name IS NOT NULL GROUP BY ALL) SELECT o.benefit_name, o.a AS our_amount, c.a AS comp_amount FROM l o JOIN l c USING (benefit_name) WHERE o.side = 'our' AND c.side = 'comp' AND o.a <> c.a",
        "report_csv_rows": f"SELECT side, row_id, benefit_name, amount FROM ({RAW})",
        "payment_matrix": f"WITH r AS ({RAW}), k AS ({keyed(NAMES)}) SELECT CASE WHEN coalesce(k.action, '') = '' THEN '기타' ELSE k.action END AS action, " + ", ".join(f"count(*) FILTER (side = '{s}'{c}) AS {s}_{n}" for n, c in (("n", ""), ("limited", " AND coalesce(coverage_limit, '') <> ''"), ("reduced", " AND coalesce(reduction_note, '') <> ''")) for s in ("our", "comp")) + " FROM r LEFT JOIN k USING (benefit_name) GROUP BY 1",
        "table_benefits": table_benefits,
        "table_quality": f"SELECT doc_id, round(0.3 + CASE WHEN bool_and(name <> '') THEN 0.3 ELSE 0 END + CASE WHEN avg(CASE WHEN has THEN 1 ELSE 0 END) >= 0.5 THEN 0.4 ELSE 0 END, 6) AS score FROM (SELECT doc_id, arg_min(coalesce(fn,''), n) AS name, count(*) FILTER (sum <> '') AS n_amounts, coalesce(regexp_matches(arg_min(sum, n) FILTER (sum <> ''), {rx(fixed.AMOUNT + '|' + fixed.RATIO)}), false) AS has FROM {opened} WHERE g > 0 GROUP BY doc_id, g) WHERE {valid} GROUP BY doc_id",
        "reading_order": f"SELECT doc_id, block_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_idx, round_even(y0 / 5, 0) * 5, x0, block_no) AS ord FROM ({BLOCKS}) WHERE {strip('text')} <> ''",
        "row_islands": f"SELECT doc_id, block_no, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY page_idx, y0, x0, block_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS group_no FROM (SELECT *, CASE WHEN lag(page_idx) OVER w IS NULL OR lag(page_idx) OVER w <> page_idx OR y0 - lag(y0) OVER w > 40 THEN 1 ELSE 0 END AS new FROM ({BLOCKS}) WHERE x0 < 130 WINDOW w AS (PARTITION BY doc_id ORDER BY page_idx, y0, x0, block_no))",
        "section_intervals": f"SELECT doc_id, {strip('regexp_replace(regexp_replace(' + clean(q('□ 무배당 ') + ' || text') + ', ' + rx('^□' + chr(92) + 's*') + ', ' + q('') + '), ' + rx(chr(92) + 's*' + chr(92) + '((?:의무부가특약|선택특약)' + chr(92) + ')' + chr(92) + 's*$') + ', ' + q('') + ')')} AS name, page_idx AS start_page, y0 AS start_y, coalesce(lead(page_idx) OVER w, 2147483647) AS end_page, coalesce(lead(y0) OVER w, 9999.0) AS end_y FROM ({BLOCKS}) WHERE x0 = 50 WINDOW w AS (PARTITION BY doc_id ORDER BY page_idx, y0, x0, block_no)",
        "first_marks": f"SELECT doc_id, coalesce(min((page_idx, y0)) FILTER (contains(text, '진단')), (max(page_idx), 9999.0))[1] AS page_idx, CAST(coalesce(min((page_idx, y0)) FILTER (contains(text, '진단')), (max(page_idx), 9999.0))[2] AS DOUBLE) AS y0 FROM ({BLOCKS}) GROUP BY doc_id",
        "first_pages": "SELECT doc_id, array_to_string(string_split(text, chr(10) || chr(10))[1:3], chr(10)) AS text FROM documents WHERE text IS NOT NULL",
        "company_keys": f"SELECT contract_id, lower(regexp_replace({strip(q(' ') + ' || insurer || ' + q(' Life　'))}, '[ 　]', '', 'g')) AS key FROM contracts",
    }
    return out | more_sql() | pair_sql()


def amount_entries_of(e: str) -> str:
    """A JSON list column as a list of (amount, condition), [] for anything else."""
    return f"CASE WHEN ltrim({t(e)}) LIKE '[%' AND json_valid({e}) THEN list_transform(CAST(json_extract({e}, '$[*]') AS JSON[]), lambda o: {{'a': coalesce(json_extract_string(o, '$.amount'), ''), 'c': coalesce(json_extract_string(o, '$.condition'), '')}}) ELSE [] END"


FLAT = """
  SELECT c.contract_id, c.insurer, c.product_name, c.contract_name, c.contract_type, coalesce(c.contract_code, '') AS code, c.source_pdf,
    row_number() OVER (PARTITION BY c.insurer, c.product_name ORDER BY CASE WHEN contract_type = 'main' THEN 0 ELSE 1 END, contract_id) - 1 AS contract_ord
  FROM contracts c"""
KEPT = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY insurer, product_name, coalesce(contract_name, ''), code, coalesce(source_pdf, '') ORDER BY contract_ord) AS nth FROM ({FLAT})) WHERE nth = 1"
ROWS_OF = "SELECT row_id, product_name, contract_name, benefit_name, trigger FROM summary_rows WHERE product_name IS NOT NULL AND contract_name IS NOT NULL"


def note_text(e: str) -> str:
    """Text of a note with line ends inside words removed and known phrases put together."""
    note = r"regexp_replace(" + e + ", " + rx(r"\n(\d{1,2}\.\s)") + r", ' ' || chr(1) || ' \1', 'g')"
    for before, after in (("가-힣", "가-힣"), ("가-힣", "A-Za-z0-9"), ("A-Za-z0-9", "가-힣"), ("0-9년개월회%", "이가을를은는의에으"), ("\"')\\]", "가-힣"), ("가-힣", "\"'(\\[")):
        for _ in range(2):
            note = f"regexp_replace({note}, {q(f'([{before}])' + chr(10) + f'([{after}])')}, '\\1\\2', 'g')"
    note = f"replace(regexp_replace({note}, '[ \t\n]+', ' ', 'g'), ' ' || chr(1) || ' ', ' ')"
    for broken, whole in fixed.BROKEN_PHRASES:
        note = f"replace({note}, {q(broken)}, {q(whole)})"
    return strip(note)


def more_sql() -> dict[str, str]:
    """SQL of nested and composed queries."""
    benefits = f"SELECT f.product_name, f.contract_name, row_number() OVER (PARTITION BY f.contract_id ORDER BY b.row_id) - 1 AS benefit_ord, b.row_id, coalesce(b.benefit_name, '') AS benefit_name, coalesce(b.trigger, '') AS trigger, f.insurer, f.source_pdf FROM ({KEPT}) f JOIN ({ROWS_OF}) b ON b.product_name = f.product_name AND b.contract_name = f.contract_name"
    entries = "SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY entry_no, entry_id) - 1 AS amount_ord, count(*) OVER (PARTITION BY row_id) AS n, coalesce(amount, '') AS amount, coalesce(condition, '') AS amount_condition, coalesce(reduction_note, '') AS reduction_note FROM amount_entries WHERE row_id IS NOT NULL"
    exported = f"SELECT b.*, coalesce(e.amount_ord, 0) AS amount_ord, coalesce(e.n, 0) AS n, coalesce(e.amount, '') AS amount, coalesce(e.amount_condition, '') AS amount_condition FROM ({benefits}) b LEFT JOIN ({entries}) e USING (row_id)"
    key = "substr(md5(concat_ws('|', coalesce(insurer,''), coalesce(product_name,''), coalesce(contract_name,''), benefit_name, amount, amount_condition, substr(trigger,1,200), coalesce(source_pdf,''))), 1, 16)"
    labels = list(dict.fromkeys([*DEFAULT.labels("disease"), *fixed.MORE_COVERED, *fixed.COMPOSITE]))
    known = "[" + ", ".join(map(q, labels)) + "]"
    composite = " ".join(f"WHEN d = {q(k)} THEN [{', '.join(map(q, v))}]" for k, v in fixed.COMPOSITE.items())
    actions = "[" + ", ".join(map(q, DEFAULT.labels("action"))) + "]"
    lines = "SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split('주) ' || text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)"
    trimmed = f"SELECT doc_id, line_no, {strip('line')} AS line FROM ({lines})"
    body = rf"SELECT * FROM ({trimmed}) WHERE line <> '' AND NOT regexp_matches(line, '^\\s*[0-9]+\\s*/\\s*[0-9]+\\s*$')".replace("\\\\", "\\")
    mark = f"regexp_matches(line, {rx(r'^주\s*\)')})"
    content = f"CASE WHEN {mark} THEN {strip('regexp_replace(line, ' + rx(r'^주\s*\)\s*') + ', ' + q('') + ')')} ELSE line END"
    opens = f"({mark} OR regexp_matches(line, {rx(r'^\d{1,2}\.\s')}))"
    hit = f"regexp_matches(line, {rx(r'\d[\d,]*\s*만?\s*원|\d+회당|\d+%')})"
    inside = f"SELECT *, max(CASE WHEN {mark} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS inside, {content} AS content FROM ({body})"
    ent = amount_entries_of("amount_detail")
    ordered = "list_filter(s, lambda y, i: list_position(s, y) = i)"
    main = strip("ac")
    single = f"(len(e) <= 1 AND {main} <> '' AND (regexp_matches({main}, {rx(fixed.PERIOD_LIMIT)}) OR NOT regexp_matches({main}, {rx(fixed.PERIODIC)})))"
    man = lambda e: f"format('{{:,}}', CAST(floor({e} / 10000.0) AS BIGINT)) || '만원'"
    note = note_text(t("notes_summary"))
    numbered = note_text(f"replace({t('notes_summary')}, ' | ', chr(10))")
    for _ in range(2):
        numbered = f"regexp_replace({numbered}, {q(f'(^|[{_WS}])([{chr(92)}p{{Nd}}]{{1,2}}[.][{_WS}])')}, '\\1' || chr(2) || '\\2', 'g')"
    cell = "concat_ws(' ', nullif(coalesce(condition,''), ''), nullif(coalesce(amount,''), ''), CASE WHEN coalesce(reduction_note,'') <> '' THEN '(단, 보험계약일부터 1년 ' || reduction_note || ' 지급)' END)"
    red = strip(f"regexp_extract(x, {rx(fixed.REDUCTION)}, 1)")
    ratio, periodic, plain = f"regexp_extract(x, {rx(fixed.RATIO)}, 0)", rx(r"^(매월|매년\(매회\)|매년)\s*(\d[\d,]+만원)"), f"regexp_extract(x, {rx(fixed.AMOUNT)}, 0)"
    rest = f"CASE WHEN regexp_extract(after, {rx(r'\(단[,，]\s*.+?\)')}, 0) <> '' THEN {clean('regexp_extract(after, ' + rx(r'\(단[,，]\s*.+?\)') + ', 0)')} ELSE {clean('substr(after, 1, 200)')} END"
    years = f"regexp_extract_all(x, {rx(fixed.YEAR_AMOUNT)}, 1)"
    sums = f"regexp_extract_all(x, {rx(fixed.YEAR_AMOUNT)}, 2)"
    cells = f"""
    SELECT entry_id, pos - 1 AS pos, {clean('ys[pos]')} AS condition, {clean('ss[pos]')} AS amount, CASE WHEN pos = len(ys) THEN red ELSE '' END AS reduction_note
    FROM (SELECT *, unnest(range(1, len(ys) + 1)) AS pos FROM (SELECT entry_id, {years} AS ys, {sums} AS ss, {red} AS red FROM (SELECT entry_id, {clean(cell)} AS x FROM amount_entries)) WHERE len(ys) > 0)
    UNION ALL
    SELECT entry_id, 0, CASE WHEN ratio <> '' THEN CASE WHEN regexp_matches(before, '^(매월|매년|매회)') THEN {strip("before || ' ' || rest")} ELSE rest END WHEN regexp_matches(x, {periodic}) THEN regexp_extract(x, {periodic}, 1) WHEN plain <> '' THEN '' ELSE x END,
      CASE WHEN ratio <> '' THEN regexp_replace({clean('ratio')}, {rx(r'\s+의\s*')}, '의 ', 'g') WHEN regexp_matches(x, {periodic}) THEN regexp_extract(x, {periodic}, 2) ELSE {clean('plain')} END,
      CASE WHEN ratio <> '' OR regexp_matches(x, {periodic}) OR plain <> '' THEN red ELSE '' END
    FROM (SELECT *, {rest} AS rest FROM (SELECT *, {strip("substr(x, 1, strpos(x, ratio) - 1)")} AS before, {strip("substr(x, strpos(x, ratio) + length(ratio))")} AS after FROM (SELECT entry_id, x, {ratio} AS ratio, {plain} AS plain, {red} AS red, len({years}) AS ny FROM (SELECT entry_id, {clean(cell)} AS x FROM amount_entries)))) WHERE ny = 0 AND x <> ''"""
    return {
        "contracts_flat": f"SELECT f.product_name, coalesce(f.contract_name, '') AS name, f.code, f.contract_ord, (SELECT count(*) FROM ({ROWS_OF}) b WHERE b.product_name = f.product_name AND b.contract_name = f.contract_name) AS n_benefits FROM ({KEPT}) f",
        "benefits_flat": f"SELECT product_name, contract_name, benefit_ord, 0 AS name_ord, benefit_name, trigger, coalesce(n, 0) AS n_amounts FROM ({benefits}) LEFT JOIN (SELECT row_id, count(*) AS n FROM amount_entries WHERE row_id IS NOT NULL GROUP BY row_id) USING (row_id)",
        "details_exported": f"SELECT product_name, contract_name, benefit_ord, amount_ord, amount, amount_condition, regexp_extract(contract_name, '갱신형|비갱신형', 0) AS renewal_type, regexp_extract(trigger, {rx(fixed.LIMIT)}, 0) AS coverage_limit, {key} AS dedupe_key, n > 1 AS several FROM ({exported})",
        "details_distinct": f"SELECT DISTINCT {key} AS dedupe_key, product_name, contract_name, benefit_name FROM ({exported})",
        "slots_cached": "SELECT row_id, coalesce(slots, c.s) AS slots FROM summary_rows r LEFT JOIN (SELECT insurer, benefit_name, max(slots) AS s FROM summary_rows WHERE slots IS NOT NULL AND insurer IS NOT NULL AND benefit_name IS NOT NULL GROUP BY ALL) c ON c.insurer = r.insurer AND c.benefit_name = r.benefit_name",
        "slots_enriched": "SELECT row_id, slots FROM summary_rows",
        "cancer_matrix": f"WITH r AS (SELECT *, {first_of(t('benefit_name'), fixed.CANCER_CLASSES, '')} AS class FROM ({RAW})), n AS (SELECT class, count(DISTINCT benefit_name) FILTER (side = 'our') AS our_n, count(DISTINCT benefit_name) FILTER (side = 'comp') AS comp_n, list_slice(list(DISTINCT (row_id, amount) ORDER BY (row_id, amount)) FILTER (side = 'our' AND coalesce(amount, '') <> ''), 1, 2) AS oa, list_slice(list(DISTINCT (row_id, amount) ORDER BY (row_id, amount)) FILTER (side = 'comp' AND coalesce(amount, '') <> ''), 1, 2) AS ca FROM r WHERE class <> '' GROUP BY class) SELECT class, our_n, comp_n, coalesce(array_to_string(list_transform(oa, lambda x: x[2]), ', '), '') AS our_amounts, coalesce(array_to_string(list_transform(ca, lambda x: x[2]), ', '), '') AS comp_amounts FROM n",
        "coverage_by_disease": sides() + f", d AS (SELECT *, list_filter(string_split(key, '|'), lambda p: list_contains({known}, p))[1] AS d FROM n), x AS (SELECT o, c, unnest(CASE WHEN d IS NULL THEN ['기타'] {composite} ELSE [d] END) AS disease FROM d) SELECT disease, CAST(sum(o) AS BIGINT) AS our, CAST(sum(c) AS BIGINT) AS comp, CAST(sum(least(o, c)) AS BIGINT) AS matched_pairs, CAST(2 * sum(least(o, c)) AS BIGINT) AS matched FROM x GROUP BY disease",
        "disease_order": sides() + f", d AS (SELECT DISTINCT unnest(CASE WHEN d IS NULL THEN ['기타'] {composite} ELSE [d] END) AS disease FROM (SELECT *, list_filter(string_split(key, '|'), lambda p: list_contains({known}, p))[1] AS d FROM n)) SELECT disease, row_number() OVER (ORDER BY coalesce(nullif(list_position(['일반암', '고액암', '갑상선암'], disease), 0), 4), disease) AS place FROM d WHERE disease <> '기타'",
        "exclusive_actions": sides() + f", a AS (SELECT o, c, coalesce(list_filter(string_split(key, '|'), lambda p: list_contains({actions}, p))[-1], '기타') AS action FROM n) SELECT 'our' AS side, action, CAST(sum(o - c) AS BIGINT) AS n FROM a WHERE o > c GROUP BY action UNION ALL SELECT 'comp', action, CAST(sum(c - o) AS BIGINT) FROM a WHERE c > o GROUP BY action",
        "line_notes": f"SELECT doc_id, note_no, note FROM (SELECT doc_id, CAST(g AS BIGINT) AS note_no, string_agg(content, ' ' ORDER BY line_no) AS note FROM (SELECT *, sum(CASE WHEN {opens} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM ({inside}) WHERE inside = 1 AND content <> '') WHERE g > 0 GROUP BY doc_id, g) WHERE length(note) > 5",
        "text_benefits": f"SELECT doc_id, group_no, name, amount FROM (SELECT doc_id, CAST(g AS BIGINT) AS group_no, arg_min(line, line_no) FILTER (NOT hit) AS name, max(line) FILTER (hit) AS amount FROM (SELECT *, coalesce(sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM (SELECT *, {hit} AS hit FROM ({body})) WHERE hit OR length(line) > 3) GROUP BY doc_id, g) WHERE name IS NOT NULL AND amount IS NOT NULL",
        "component_riders": f"SELECT product_name AS doc_id, rider, min(line_no) AS line_no FROM (SELECT product_name, {strip('contract_name')} AS rider, row_number() OVER (PARTITION BY product_name ORDER BY contract_id, contract_name) + 2 AS line_no FROM contracts WHERE product_name IS NOT NULL) WHERE rider <> '' GROUP BY ALL",
        "rider_cells": f"SELECT contract_id, 0 AS pos, {clean('contract_name')} AS rider FROM contracts WHERE length({clean('contract_name')}) > 3 AND NOT regexp_matches(contract_name, ' [+] |[+] [가-힣A-Za-z]') UNION ALL SELECT contract_id, CAST(pos - 1 AS BIGINT), l[pos] FROM (SELECT contract_id, l, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT contract_id, list_filter(list_transform(regexp_split_to_array(contract_name, ' ?[+] +'), lambda p: {clean('p')}), lambda p: length(p) > 3) AS l FROM contracts WHERE regexp_matches(contract_name, ' [+] |[+] [가-힣A-Za-z]')))",
        "contract_headers": f"SELECT contract_id, CASE WHEN ok THEN {clean('contract_name')} END AS name, CASE WHEN ok THEN contract_code END AS code, CASE WHEN ok THEN '1,000만원' END AS reference, CAST(contract_id AS VARCHAR) AS management_no, {clean(q('무배당 ') + ' || product_name')} AS product FROM (SELECT *, regexp_matches(coalesce(contract_code, ''), '^[A-Za-z0-9]+[.][0-9]+([.][0-9]+)?$') AS ok FROM contracts)",
        "coordinate_benefits": f"WITH b AS ({BLOCKS}), i AS (SELECT *, CAST(sum(CASE WHEN x0 = 50 AND (pp IS NULL OR pp <> page_idx OR y0 - py > 40) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_idx, y0, x0, block_no) AS BIGINT) AS g FROM (SELECT *, lag(page_idx) OVER w AS pp, lag(y0) OVER w AS py FROM b WHERE x0 = 50 AND NOT regexp_matches({clean('text')}, {rx(r'급\s*부\s*명|지\s*급\s*사\s*유|지\s*급\s*금\s*액')}) WINDOW w AS (PARTITION BY doc_id ORDER BY page_idx, y0, x0, block_no) UNION ALL SELECT *, 0, 0 FROM b WHERE x0 > 50 AND NOT regexp_matches({clean('text')}, {rx(r'급\s*부\s*명|지\s*급\s*사\s*유|지\s*급\s*금\s*액')}))) SELECT doc_id, g AS group_no, string_agg({clean('text')}, ' ' ORDER BY page_idx, y0, x0, block_no) FILTER (x0 = 50) AS name, {clean(f'coalesce(string_agg(text, {q(chr(32))} ORDER BY page_idx, y0, x0, block_no) FILTER (x0 = 200), {q(str())})')} AS trigger, count(*) FILTER (x0 = 400 AND regexp_matches({clean('text')}, {rx(fixed.AMOUNT)})) AS n_amounts FROM i WHERE g > 0 GROUP BY doc_id, g",
        "rider_directories": f"WITH n AS (SELECT DISTINCT contract_name AS name, {squeeze(t('contract_name'))} AS k FROM contracts), d AS (SELECT DISTINCT disease AS directory, {squeeze(t('disease'))} AS k2 FROM benefit_catalog), j AS (SELECT name, directory, k = k2 AS same FROM n JOIN d ON contains(k, k2) OR contains(k2, k) WHERE k <> '' AND k2 <> '') SELECT name, min(directory) AS directory FROM j WHERE same OR name NOT IN (SELECT name FROM j WHERE same) GROUP BY name",
        "note_split": f"SELECT row_id, CAST(pos - 1 AS BIGINT) AS pos, l[pos] AS note FROM (SELECT row_id, l, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT row_id, CASE WHEN len(k) > 0 THEN k WHEN w <> '' THEN [w] ELSE [] END AS l FROM (SELECT row_id, list_filter(list_transform(string_split(n, chr(2)), lambda p: {strip('p')}), lambda p: regexp_matches(p, {q(f'^[{chr(92)}p{{Nd}}]{{1,2}}[.]([{_WS}]|$)')})) AS k, {strip('replace(n, chr(2), ' + q('') + ')')} AS w FROM (SELECT row_id, {numbered} AS n FROM summary_rows))))",
        "note_repair": f"SELECT row_id, {note} AS note FROM summary_rows",
        "amount_cells": cells,
        "amount_display": f"SELECT row_id, CASE WHEN len(e) = 0 THEN CASE WHEN ac <> '' AND am <> '' AND NOT contains(am, ac) THEN {strip('CASE WHEN sc <> ' + q('') + ' THEN sc ELSE ac END || ' + q(' ') + ' || am')} ELSE am END WHEN len(k) > 0 THEN array_to_string(list_transform(list_filter(list_transform(k, lambda x: x.k), lambda y, i: list_position(list_transform(k, lambda x: x.k), y) = i), lambda g: CASE WHEN g = '' THEN '' ELSE g || ' ' END || CASE WHEN list_min(list_transform(list_filter(k, lambda x: x.k = g), lambda x: x.v)) = list_max(list_transform(list_filter(k, lambda x: x.k = g), lambda x: x.v)) THEN {man('list_min(list_transform(list_filter(k, lambda x: x.k = g), lambda x: x.v))')} ELSE {man('list_min(list_transform(list_filter(k, lambda x: x.k = g), lambda x: x.v))')} || '~' || {man('list_max(list_transform(list_filter(k, lambda x: x.k = g), lambda x: x.v))')} END), chr(10)) ELSE coalesce(nullif(e[1].a, ''), am) END AS shown FROM (SELECT row_id, e, am, ac, {short_condition('ac')} AS sc, list_filter(list_transform(e, lambda x: {{'k': CASE WHEN x.c <> '' THEN {short_condition('x.c')} ELSE '' END, 'v': {won('x.a')}}}), lambda z: z.v IS NOT NULL) AS k FROM (SELECT row_id, {ent} AS e, {t('amount')} AS am, {t('amount_condition')} AS ac FROM summary_rows))",
        "amount_info": f"SELECT row_id, coalesce(list_max(list_transform(e, lambda x: {won('x.a')})), {won('am')}) AS value, len(e) > 1 OR {single} AS conditional, CASE WHEN len(e) > 1 THEN array_to_string({ordered}, ' / ') WHEN {single} THEN CASE WHEN {short_condition(main)} <> '' THEN {short_condition(main)} ELSE substr({main}, 1, 20) END ELSE '' END AS note FROM (SELECT row_id, e, am, ac, list_filter(list_transform(list_filter(e, lambda x: {strip('x.c')} <> ''), lambda x: {short_condition('x.c')}), lambda y: y <> '') AS s FROM (SELECT row_id, {ent} AS e, {t('amount')} AS am, {t('amount_condition')} AS ac FROM summary_rows))",
    }


def info_sql(e: str, am: str, ac: str) -> tuple[str, str, str]:
    """Value, conditionality and note of amounts: e is a list of (a, c)."""
    main = strip(ac)
    notes = f"list_filter(list_transform(list_filter({e}, lambda x: {strip('x.c')} <> ''), lambda x: {short_condition('x.c')}), lambda y: y <> '')"
    ordered = f"list_filter({notes}, lambda y, i: list_position({notes}, y) = i)"
    single = f"(len({e}) <= 1 AND {main} <> '' AND (regexp_matches({main}, {rx(fixed.PERIOD_LIMIT)}) OR NOT regexp_matches({main}, {rx(fixed.PERIODIC)})))"
    value = f"coalesce(list_max(list_transform({e}, lambda x: {won('x.a')})), {won(am)})"
    note = f"CASE WHEN len({e}) > 1 THEN array_to_string({ordered}, ' / ') WHEN {single} THEN CASE WHEN {short_condition(main)} <> '' THEN {short_condition(main)} ELSE substr({main}, 1, 20) END ELSE '' END"
    return value, f"(len({e}) > 1 OR {single})", note


def manwon(e: str) -> str:
    return f"format('{{:,}}', CAST(floor({e} / 10000.0) AS BIGINT)) || '만원'"


def shown_sql(e: str, am: str, ac: str) -> str:
    """Displayed amounts."""
    k = f"list_filter(list_transform({e}, lambda x: {{'k': CASE WHEN x.c <> '' THEN {short_condition('x.c')} ELSE '' END, 'v': {won('x.a')}}}), lambda z: z.v IS NOT NULL)"
    names = f"list_transform({k}, lambda x: x.k)"
    vals = f"list_transform(list_filter({k}, lambda x: x.k = g), lambda x: x.v)"
    line = f"CASE WHEN g = '' THEN '' ELSE g || ' ' END || CASE WHEN list_min({vals}) = list_max({vals}) THEN {manwon(f'list_min({vals})')} ELSE {manwon(f'list_min({vals})')} || '~' || {manwon(f'list_max({vals})')} END"
    plain = f"CASE WHEN {ac} <> '' AND {am} <> '' AND NOT contains({am}, {ac}) THEN {strip(f'CASE WHEN {short_condition(ac)} <> {q(str())} THEN {short_condition(ac)} ELSE {ac} END || {q(chr(32))} || {am}')} ELSE {am} END"
    return f"CASE WHEN len({e}) = 0 THEN {plain} WHEN len({k}) > 0 THEN array_to_string(list_transform(list_filter({names}, lambda y, i: list_position({names}, y) = i), lambda g: {line}), chr(10)) ELSE coalesce(nullif({e}[1].a, ''), {am}) END"


def pairs_cte() -> str:
    """Greedy pairing as a recursion over the order of our rows, all keys at once; pairs p(key, our_ord, comp_ord, match_type)."""
    base = f"SELECT row_id, insurer, {GROUPS.replace('AS insurer', 'AS ins')}, coalesce(amount,'') AS amount, coalesce(amount_condition,'') AS amount_condition, coalesce(trigger,'') AS trigger, coalesce(reduction_note,'') AS reduction_note, coalesce(waiting_period,'') AS waiting_period, slots FROM summary_rows WHERE insurer IN ({OUR}, {COMP})"
    g = "insurer, product_name, contract_name, benefit_name, renewal_type, coverage_limit"
    return f"""WITH RECURSIVE b AS ({base}),
    en AS (SELECT {g}, list({{'a': amount, 'c': amount_condition}} ORDER BY o) AS e FROM (SELECT {g}, amount, amount_condition, substr(trigger, 1, 80) AS st, min(row_id) AS o FROM b GROUP BY ALL) GROUP BY ALL),
    fi AS (SELECT {g}, min(row_id) AS ord, arg_min(amount, row_id) AS am, arg_min(amount_condition, row_id) AS ac, arg_min(reduction_note, row_id) AS rn, arg_min(waiting_period, row_id) AS wp, coalesce(arg_min(trigger, row_id) FILTER (trigger <> ''), '') AS tr, arg_min({{'s': slots}}, row_id).s AS sl FROM b GROUP BY ALL),
    k AS ({keyed("SELECT DISTINCT benefit_name FROM (SELECT coalesce(benefit_name, '') AS benefit_name FROM summary_rows)")}),
    c0 AS (SELECT fi.*, CASE WHEN len(en.e) > 1 THEN en.e ELSE [] END AS e, k.key FROM fi JOIN en USING ({g}) JOIN k USING (benefit_name)),
    c AS (SELECT *, {shown_sql('e', 'am', 'ac')} AS shown, {info_sql('e', 'am', 'ac')[0]} AS val, {info_sql('e', 'am', 'ac')[1]} AS cond, {info_sql('e', 'am', 'ac')[2]} AS note FROM c0),
    gr AS (SELECT key, coalesce(list({{'ord': ord, 'am': am, 'ch': list_distinct(string_split(am, ''))}} ORDER BY ord) FILTER (insurer = {OUR}), []) AS ours, coalesce(list({{'ord': ord, 'am': am, 'ch': list_distinct(string_split(am, ''))}} ORDER BY ord) FILTER (insurer = {COMP}), []) AS comps FROM c GROUP BY key),
    r AS (
      SELECT key, 1 AS i, comps AS free, CAST(NULL AS BIGINT) AS our_ord, CAST(NULL AS BIGINT) AS comp_ord FROM gr
      UNION ALL
      SELECT key, i + 1, list_filter(free, lambda x: t IS NULL OR x.ord <> t), o.ord, t FROM (
        SELECT r.key, r.i, r.free, o, list_sort(list_transform(r.free, lambda x: {{'s': -CASE WHEN x.am = o.am THEN 1.0 WHEN x.am = '' OR o.am = '' THEN 0.0 ELSE len(list_intersect(x.ch, o.ch)) / greatest(len(x.ch), len(o.ch)) END, 'o': x.ord}}))[1].o AS t
        FROM (SELECT r.*, gr.ours[r.i] AS o FROM r JOIN gr USING (key) WHERE r.i <= len(gr.ours)) r)),
    p AS (SELECT key, our_ord, comp_ord, CASE WHEN comp_ord IS NULL THEN 'our_only' ELSE 'matched' END AS match_type FROM r WHERE our_ord IS NOT NULL
      UNION ALL SELECT key, NULL, unnest(list_transform(free, lambda x: x.ord)), 'comp_only' FROM r JOIN gr USING (key) WHERE r.i = len(gr.ours) + 1),
    v0 AS (SELECT p.*, coalesce(o.benefit_name, '') AS our_name, coalesce(x.benefit_name, '') AS comp_name, coalesce(o.shown, '') AS our_amount, coalesce(x.shown, '') AS comp_amount, o.val AS ov, x.val AS xv, o.cond AS oc, x.cond AS xc, o.note AS ono, x.note AS xno,
        CASE WHEN o.cond AND o.note <> '' THEN '(' || o.note || ')' ELSE '' END AS os, CASE WHEN x.cond AND x.note <> '' THEN '(' || x.note || ')' ELSE '' END AS xs FROM p LEFT JOIN c o ON o.ord = our_ord LEFT JOIN c x ON x.ord = comp_ord),
    v AS (SELECT *, CASE WHEN match_type = 'our_only' THEN ['당사단독', ''] WHEN match_type = 'comp_only' THEN ['타사단독', ''] WHEN ov IS NULL AND xv IS NULL THEN ['비교불가', ''] WHEN ov IS NULL THEN ['타사우위', '금액↓'] WHEN xv IS NULL THEN ['당사우위', '금액↑']
        WHEN ov > xv THEN ['당사우위', '금액↑' || CASE WHEN xc THEN ' · 타사최대' || {manwon('xv')} || xs ELSE '' END] WHEN ov < xv THEN ['타사우위', '금액↓' || CASE WHEN oc THEN ' · 당사최대' || {manwon('ov')} || os ELSE '' END]
        WHEN oc AND xc THEN CASE WHEN ono <> xno THEN ['조건상이', '당사' || os || ' / 타사' || xs] ELSE ['동일', ''] END WHEN oc THEN ['타사우위', '조건없음 (당사' || os || ')'] WHEN xc THEN ['당사우위', '조건없음 (타사' || xs || ')'] ELSE ['동일', ''] END AS w FROM v0),
    z AS (SELECT key, match_type, our_ord, comp_ord, our_name, comp_name, our_amount, comp_amount, w[1] AS advantage, w[2] AS rationale FROM v)"""


def pair_sql() -> dict[str, str]:
    """SQL of everything made of the pairs of two products."""
    actions = "[" + ", ".join(map(q, DEFAULT.labels("action"))) + "]"
    action = f"coalesce(list_filter(string_split(key, '|'), lambda p: list_contains({actions}, p))[-1], '기타')"
    dash = lambda c: f"coalesce(nullif({c}, ''), '—') AS {c}"
    n = lambda cond: f"count(*) FILTER ({cond})"
    m = "match_type = 'matched'"
    share = lambda c: f"CASE WHEN matched = 0 THEN 0.0 ELSE {c} * 100.0 / matched END"
    counts = f"SELECT {n(m)} AS matched, {n(m + chr(32) + 'AND advantage = ' + q('당사우위'))} AS our_adv, {n(m + ' AND advantage = ' + q('타사우위'))} AS comp_adv, {n(m + ' AND advantage = ' + q('동일'))} AS equal, {n(m + ' AND advantage = ' + q('조건상이'))} AS cond_diff, {n('match_type = ' + q('our_only'))} AS our_only, {n('match_type = ' + q('comp_only'))} AS comp_only FROM z"
    alone = "CASE WHEN our_only > 0 THEN ' · 당사 단독 ' || our_only || '건' ELSE '' END || CASE WHEN comp_only > 0 THEN ' · 타사 단독 ' || comp_only || '건' ELSE '' END"
    slots = ["('amount_display', 0, '금액')", "('payment_freq', 1, '지급조건')", "('payment_limit', 2, '지급한도')", "('reduction_rule', 3, '감액조건')", "('start_condition', 4, '보장개시')", "('trigger', 5, '지급사유')"]
    raw = lambda p: f"CASE d WHEN 'amount_display' THEN {p}.shown WHEN 'payment_freq' THEN {p}.ac WHEN 'payment_limit' THEN {p}.coverage_limit WHEN 'reduction_rule' THEN {p}.rn WHEN 'start_condition' THEN {p}.wp ELSE {p}.tr END"
    filled = lambda p: f"coalesce(nullif(CASE WHEN ltrim(coalesce({p}.sl, '')) LIKE '{{%' AND json_valid({p}.sl) THEN json_extract_string({p}.sl, '$.' || d) END, ''), {raw(p)}, '')"
    kinds = {"payment_freq": "display_only", "payment_limit": "limit_numeric", "reduction_rule": "none_is_better", "start_condition": "display_only", "trigger": "display_only"}
    verdicts = "CASE d WHEN 'amount_display' THEN adv " + " ".join(f"WHEN '{d}' THEN {verdict(k, 'v')}" for d, k in kinds.items()) + " END"
    slot_rows = f"SELECT key, our_ord, comp_ord, our_name, comp_name, slot_ord, d AS dimension, label, v AS our_value, next_v AS comp_value, {verdicts} AS advantage FROM (SELECT z.key, our_ord, comp_ord, our_name, comp_name, z.advantage AS adv, d, slot_ord, label, {filled('o')} AS v, {filled('x')} AS next_v FROM z JOIN c o ON o.ord = our_ord JOIN c x ON x.ord = comp_ord, (VALUES {', '.join(slots)}) AS s(d, slot_ord, label) WHERE {m})"
    side = lambda s: f"SELECT '{s}' AS side, count(*) AS total, {n('match_type = ' + q(s + '_only'))} AS alone, coalesce(array_to_string(list_slice(list({s}_name ORDER BY {s}_ord, {s}_name) FILTER (match_type = '{s}_only'), 1, 5), ' / '), '') AS names FROM z WHERE match_type IN ('matched', '{s}_only')"
    w = pairs_cte()
    return {
        "match_pairs": f"{w} SELECT * FROM p",
        "compared_pairs": f"{w} SELECT * FROM z",
        "amount_table": f"{w} SELECT CASE match_type WHEN 'matched' THEN 0 WHEN 'our_only' THEN 1 ELSE 2 END AS section, key, our_ord, comp_ord, {dash('our_name')}, {dash('comp_name')}, {dash('our_amount')}, {dash('comp_amount')}, advantage, rationale FROM z",
        "slot_table": f"{w} {slot_rows}",
        "comparison_summary": f"{w} SELECT {n(m)} AS matched, {n('match_type = ' + q('our_only'))} AS our_only, {n('match_type = ' + q('comp_only'))} AS comp_only, {n(m + ' AND advantage IN (' + ', '.join(map(q, ('당사우위', '타사우위', '조건상이', '비교불가'))) + ')')} AS diff, count(*) AS total FROM z",
        "action_scores": f"{w} SELECT {action} AS action, {n('advantage = ' + q('당사우위'))} AS win, {n('advantage = ' + q('타사우위'))} AS lose, {n('advantage NOT IN (' + q('당사우위') + ', ' + q('타사우위') + ')')} AS rest FROM z WHERE {m} GROUP BY 1",
        "action_margins": f"{w}, s AS (SELECT {action} AS action, {n('advantage = ' + q('당사우위'))} - {n('advantage = ' + q('타사우위'))} AS margin FROM z WHERE {m} GROUP BY 1) SELECT action, margin, row_number() OVER (ORDER BY margin DESC, action) AS place FROM s",
        "position": f"{w}, t AS ({counts}), u AS (SELECT *, CASE WHEN matched = 0 THEN '단독보장중심' WHEN our_adv > comp_adv AND {share('our_adv')} >= 50 THEN '우위' WHEN comp_adv > our_adv AND {share('comp_adv')} >= 50 THEN '열위' ELSE '혼재' END AS position, CAST(round_even({share('our_adv')}, 0) AS BIGINT) AS our_share, CAST(round_even({share('comp_adv')}, 0) AS BIGINT) AS comp_share FROM t) SELECT *, CASE WHEN matched = 0 THEN '매칭 급부 없음 — 당사 ' || our_only || '건 단독 / 타사 ' || comp_only || '건 단독' ELSE '매칭 ' || matched || '건 중 당사우위 ' || our_adv || '건(' || our_share || '%) / 타사우위 ' || comp_adv || '건(' || comp_share || '%)' || {alone} END AS headline FROM u",
        "top_gaps": f"{w} SELECT our_ord, coalesce(nullif(our_name, ''), comp_name) AS name, {manwon('a')} AS our_amt, {manwon('b')} AS comp_amt, CAST(round_even((a - b) / b * 100, 0) AS BIGINT) AS gap_pct, advantage AS side FROM (SELECT *, {won('our_amount')} AS a, {won('comp_amount')} AS b FROM z WHERE {m} AND advantage IN ('당사우위', '타사우위')) WHERE a > 0 AND b > 0 ORDER BY abs(round_even((a - b) / b * 100, 0)) DESC, our_ord LIMIT 3",
        "deep_dive": f"{w} {side('our')} UNION ALL {side('comp')}",
    }
