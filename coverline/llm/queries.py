"""Registered queries of the training-data operators."""

from __future__ import annotations

from coverline.session import table


def p1_found(spark, d):
    from coverline.llm.mapping import mapping_found

    return mapping_found(table(spark, d, "summary_rows"), table(spark, d, "synonyms"), table(spark, d, "benefit_catalog"))


def p2_found(spark, d):
    from coverline.llm.incremental import repeats_found

    return repeats_found(*[table(spark, d, t) for t in ("summary_rows", "artifacts", "synonyms", "benefit_catalog")])


def p4_found(spark, d):
    from coverline.llm.scans import defects_found

    return defects_found(table(spark, d, "summary_rows"), table(spark, d, "amount_entries"))


def p4_repaired(spark, d):
    from coverline.llm.scans import repaired

    return repaired(table(spark, d, "summary_rows"), table(spark, d, "amount_entries"))


def p5_records(spark, d):
    from coverline.llm.formatting import collapse

    return collapse(table(spark, d, "summary_rows"))


def p5_found(spark, d):
    from coverline.llm.formatting import copies_found

    return copies_found(table(spark, d, "summary_rows"))


def p6_found(spark, d):
    from coverline.llm.confusables import looks_found

    return looks_found(table(spark, d, "summary_rows"), table(spark, d, "benefit_catalog"), table(spark, d, "contracts"))


def p6_forms(spark, d):
    from coverline.llm.confusables import same_look

    return table(spark, d, "summary_rows").select("row_id", same_look("benefit_name").alias("benefit_form"), same_look("contract_name").alias("contract_form"))


def p7_containers(spark, d):
    from coverline.llm.packing import containers

    return containers(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


def p7_fill(spark, d):
    from coverline.llm.packing import fills

    return fills(p7_containers(spark, d))


def p8_selection(spark, d):
    from coverline.llm.mixing import mixed

    return mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark, d):
    from coverline.llm.mixing import shares

    return shares(p8_selection(spark, d), table(spark, d, "mix_targets"))


def p9_found(spark, d):
    from coverline.llm.sentences import sentence_units

    return sentence_units(table(spark, d, "documents"))


def queries():
    return {k: f for k, f in globals().items() if k.startswith("p") and k[1].isdigit()}


# Copies by canonical text, worked out by plain grouping; white space as the engine's expressions know it.
_P5 = r"""
WITH c AS (
  SELECT row_id, lower(regexp_replace(concat_ws(chr(1), {fields}, CASE WHEN json_valid(amount_detail) AND json_type(amount_detail) = 'ARRAY' THEN array_to_string(list_transform(CAST(json_extract(amount_detail, '$[*]') AS JSON[]),
    lambda o: array_to_string(list_transform(list_sort(json_keys(o)), lambda k: k || chr(2) || coalesce(json_extract_string(o, k), '')), chr(3))), chr(4)) ELSE coalesce(amount_detail, '') END),
    '[\s\x0b\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\pP]+', '', 'g')) AS t FROM summary_rows)
SELECT min(row_id) AS keep_row_id, count(*) AS n_copies FROM c GROUP BY t HAVING count(*) >= 2"""


def oracle_sql():
    from coverline.llm.formatting import FIELDS

    text = _P5.replace("{fields}", ", ".join(f"coalesce({f}, '')" for f in FIELDS)).replace("\\\\", "\\")
    return {"p5_found": text, "p5_records": text.replace(" HAVING count(*) >= 2", "")}
