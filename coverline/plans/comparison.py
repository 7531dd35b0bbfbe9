"""From detail rows to a comparison of two products: filter, collapse, key, match, compare."""

from __future__ import annotations

from pyspark.sql import DataFrame

from coverline.functions.text import text
from coverline.functions.lexicon import DEFAULT, Lexicon, canonical_key
from coverline.operators import compare, matching
from coverline.operators.catalog import ALL, in_context
from coverline.operators.collapse import comparison_rows
from coverline.session import cut


def side(details: DataFrame, company: str, product: str = ALL, rider: str = ALL, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Comparison rows of one side with their keys; the filter reaches the scan, as its columns are group keys."""
    rows = in_context(details, company, product, rider)
    names = rows.select(text("benefit_name").alias("benefit_name")).distinct().withColumn("key", canonical_key("benefit_name", lexicon))
    return comparison_rows(rows).join(names, "benefit_name")


def compare_sides(our: DataFrame, comp: DataFrame, lexicon: Lexicon = DEFAULT) -> dict[str, DataFrame]:
    """All tables of a comparison. Pairs are written to the shared folder once, as every table is made of them."""
    pairs = cut(compare.compared(matching.paired(our, comp), our, comp), "pairs")
    slots = compare.slot_table(pairs)
    return {
        "pairs": pairs, "slots": slots, "amounts": compare.amount_table(pairs), "summary": compare.summary(pairs), "coverage": compare.coverage(compare.counted(pairs), lexicon),
        "scores": compare.action_scores(pairs, lexicon), "exclusive": compare.exclusive_actions(compare.counted(pairs), lexicon), "position": compare.position(pairs),
        "gaps": compare.top_gaps(pairs), "points": compare.key_points(pairs, slots, lexicon), "facts": compare.deep_dive(pairs),
    }
