"""Classification of descriptions by the longest keyword they contain."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories, their kinds, and the item types of each.
TAXONOMY = {
    "Professional Services": {
        "Consulting": ["Management Consulting", "IT Consulting", "Financial Consulting", "Legal Consulting", "Strategy Consulting"],
        "Accounting": ["Bookkeeping", "Tax Preparation", "Audit Services", "Payroll Services"],
        "Legal": ["Legal Services", "Contract Review", "Compliance Advisory"],
        "Engineering": ["Civil Engineering", "Structural Engineering", "MEP Engineering"],
        "Architecture": ["Architectural Design", "Space Planning", "Interior Design"],
    },
    "Construction": {
        "Labor": ["General Labor", "Skilled Labor", "Supervision", "Project Management"],
        "Subcontracting": ["Electrical", "Plumbing", "HVAC", "Concrete", "Framing", "Roofing", "Painting", "Flooring"],
        "Equipment Rental": ["Heavy Equipment", "Small Tools", "Scaffolding", "Temporary Facilities"],
    },
    "Raw Materials": {
        "Metals": ["Steel Rebar", "Structural Steel", "Aluminum", "Copper", "Sheet Metal"],
        "Concrete": ["Ready Mix", "Precast", "Cement", "Aggregates"],
        "Lumber": ["Framing Lumber", "Plywood", "Engineered Wood", "Hardwood"],
        "Pipes & Fittings": ["PVC Pipe", "Copper Pipe", "Steel Pipe", "Fittings", "Valves"],
    },
    "Office & Administrative": {
        "Supplies": ["General Office Supplies", "Paper", "Toner/Ink", "Stationery"],
        "Technology": ["Software Licenses", "Hardware", "IT Support", "Cloud Services"],
        "Furniture": ["Office Furniture", "Ergonomic Equipment"],
    },
    "Facilities": {
        "Maintenance": ["Building Maintenance", "Grounds Maintenance", "HVAC Maintenance"],
        "Cleaning": ["Janitorial Services", "Window Cleaning", "Waste Management"],
        "Security": ["Security Guards", "Security Systems", "Access Control"],
        "Utilities": ["Electricity", "Water", "Gas", "Internet/Telecom"],
    },
    "Healthcare": {
        "Medical Supplies": ["Disposables", "Instruments", "PPE", "Lab Supplies"],
        "Pharmaceuticals": ["Medications", "Vaccines", "IV Solutions"],
        "Equipment": ["Medical Equipment", "Diagnostic Equipment", "Patient Monitoring"],
        "Services": ["Lab Services", "Imaging Services", "Staffing/Temporary"],
    },
    "Transportation": {
        "Freight": ["Trucking", "Rail", "Air Freight", "Ocean Freight"],
        "Courier": ["Express Delivery", "Local Delivery", "Mail Services"],
        "Fleet": ["Vehicle Maintenance", "Fuel", "Leasing"],
    },
    "Insurance & Finance": {
        "Insurance": ["General Liability", "Workers Comp", "Property Insurance", "Vehicle Insurance"],
        "Financial": ["Banking Fees", "Factoring", "Credit Card Processing"],
    },
}


@cache
def keywords() -> dict[str, str]:
    """Keyword to path: kinds and whole item types give their path, the last one said counts; a single word of three letters or more
    gives the path of the first item type that has it, unless it is a kind or a whole type itself."""
    whole: dict[str, str] = {}
    single: dict[str, str] = {}
    order: list[str] = []
    for category, kinds in TAXONOMY.items():
        for kind, types in kinds.items():
            for name, path in [(kind, f"{category} > {kind}"), *((t, f"{category} > {kind} > {t}") for t in types)]:
                whole[name.lower()] = path
                order.append(name.lower())
                for word in name.lower().split() if name != kind else ():
                    word = word.strip("/&")
                    if len(word) > 2 and word not in ("and", "the", "for"):
                        single.setdefault(word, path)
                        order.append(word)
    return {w: whole.get(w, single.get(w, "")) for w in dict.fromkeys(order) if len(w) > 2}


def classify(c: Column) -> Column:
    """The path of the longest keyword in the text, of equally long ones the first; null without one. No join: the table is small
    and fixed, so it is an array that is filtered by each text."""
    low = F.lower(F.coalesce(c, F.lit("")))
    table = F.array(*[F.struct(F.lit(-len(k)).alias("size"), F.lit(i).alias("pos"), F.lit(k).alias("word"), F.lit(v).alias("path")) for i, (k, v) in enumerate(keywords().items())])
    return F.array_min(F.filter(table, lambda k: F.contains(low, k["word"])))["path"]
