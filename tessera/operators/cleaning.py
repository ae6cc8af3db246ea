"""Facts of partner sheets as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fact patterns of a partner sheet.
FACTS = {
    "code": r"(?i)code apporteur\s*:?\s*([A-Z0-9-]{3,})",
    "frequency": r"(?i)(quotidienne|hebdomadaire|mensuelle|trimestrielle)",
}


def partner_facts(sheet: Column) -> dict[str, Column]:
    """Facts of a partner sheet as native columns."""
    products = F.regexp_extract(sheet, r"(?ims)^##\s*produits[^\n]*\n(.*?)(?=^##|\z)", 1)
    return {
        "code": F.nullif(F.regexp_extract(sheet, FACTS["code"], 1), F.lit("")),
        "letter": sheet.rlike(r"(?i)lettre d.autorisation\s*:?\s*oui"),
        "average_price": sheet.rlike(r"(?i)prix (?:d.achat )?moyen[^\n]*\boui\b"),
        "frequency": F.nullif(F.lower(F.regexp_extract(sheet, FACTS["frequency"], 1)), F.lit("")),
        "products": F.slice(F.filter(F.transform(F.split(products, r"[\n,;]"), lambda x: F.trim(F.regexp_replace(x, r"^\s*[-*]\s*", ""))), lambda x: x != ""), 1, 60),
    }
