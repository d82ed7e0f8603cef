"""Mapping the headers of a file to the fields of an invoice, and casting the columns."""

from __future__ import annotations

import difflib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersift.functions.amounts import parse_amount
from ledgersift.functions.dates import parse_date

# Fields with their kinds; the first four must be there.
FIELDS = {
    "invoice_number": "string", "vendor_name": "string", "invoice_date": "date", "total_amount": "decimal", "vendor_id": "string", "line_item_description": "string", "unit_price": "decimal", "quantity": "decimal",
    "po_number": "string", "payment_date": "date", "payment_status": "string", "project_code": "string", "cost_center": "string", "approved_by": "string", "submission_email": "string",
}
REQUIRED = list(FIELDS)[:4]
# Words of headers.
DOCUMENT, SUPPLIER, NUMBER, SUM, DAY = ["inv", "invoice", "bill"], ["vendor", "supplier", "vend", "card", "contact"], ["num", "no", "#", "number"], ["amt", "amount"], ["date", "dt"]
# Wordings of headers, a list for each field. A header has a wording if it has, for each group of words, one of the group; ONE marks a
# group that must be the whole header.
ONE = "the only word"
WORDINGS = {
    "payment_date": [[["pay", "payment", "paid", "remit"], DAY], [["date"], ["paid"]], [["fully"], ["paid"]], [["paiddate"]]],
    "payment_status": [[["pay", "payment"], ["status"]], [ONE, ["status"]], [["doc"], ["status"]]],
    "invoice_number": [[DOCUMENT, [*NUMBER, "nbr", "id"]], [["transaction"], NUMBER], [["doc"], ["num"]], [ONE, ["reference"]]],
    "invoice_date": [[[*DOCUMENT, "doc"], DAY], [ONE, DAY]],
    "vendor_id": [[SUPPLIER, ["id", "code", *NUMBER, "account"]]],
    "vendor_name": [[SUPPLIER, ["name", "nm"]], [ONE, ["vendor", "supplier"]]],
    "unit_price": [[["unit"], ["price", "cost", *SUM]], [ONE, ["price", "rate"]]],
    "total_amount": [[["total", "net", "doc", "invoice"], [*SUM, "sum", "total"]], [ONE, [*SUM, "total"]], [SUM, ["usd"]]],
    "quantity": [[ONE, ["qty", "quantity", "units", "count"]]],
    "line_item_description": [[["item"], ["desc", "description"]], [ONE, ["desc", "description", "dscription", "detail", "details", "memo"]]],
    "po_number": [[["po"], NUMBER], [["purchase"], ["order"]], [["num"], ["at"], ["card"]], [["order"], ["number"]], [ONE, ["po"]]],
    "project_code": [[["project"]], [ONE, ["job"]]],
    "cost_center": [[["cost"], ["center", "centre"]], [ONE, ["dept", "department"]]],
    "approved_by": [[["approved", "approver", "approval"]]],
    "submission_email": [[["email"]]],
}
# Export headers of common bookkeeping systems.
TEMPLATES = {
    "netsuite": dict(invoice_number="Transaction Number", vendor_id="Vendor ID", vendor_name="Vendor Name", invoice_date="Date", total_amount="Amount", line_item_description="Item Description", unit_price="Rate", quantity="Quantity", po_number="PO #", payment_date="Date Paid", payment_status="Status"),
    "quickbooks": dict(invoice_number="Bill No.", vendor_id="Vendor", vendor_name="Vendor", invoice_date="Bill Date", total_amount="Amount", line_item_description="Description", unit_price="Rate", quantity="Qty", po_number="P.O. Number", payment_date="Payment Date", payment_status="Payment Status"),
    "sage": dict(invoice_number="Reference", vendor_id="Supplier Account", vendor_name="Supplier Name", invoice_date="Invoice Date", total_amount="Net Amount", line_item_description="Details", unit_price="Unit Price", quantity="Quantity", po_number="Order Number", payment_date="Date Paid", payment_status="Status"),
    "sap_b1": dict(invoice_number="DocNum", vendor_id="CardCode", vendor_name="CardName", invoice_date="DocDate", total_amount="DocTotal", line_item_description="Dscription", unit_price="Price", quantity="Quantity", po_number="NumAtCard", payment_date="PaidDate", payment_status="DocStatus"),
    "xero": dict(invoice_number="InvoiceNumber", vendor_id="ContactID", vendor_name="ContactName", invoice_date="InvoiceDate", total_amount="Total", line_item_description="Description", unit_price="UnitAmount", quantity="Quantity"),
}
EXACT, NEAR, TYPED = 0.90, 0.80, 0.10


def header_words(header: str) -> list[str]:
    """The words of a header: split at blanks, marks and changes of case, with p.o. as po."""
    text = re.sub(r"\bp\.?\s?o\.?(?=\W|$)", "po", header, flags=re.IGNORECASE)
    text = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", text)
    return re.findall(r"[a-z0-9]+|#", text.lower())


def _fits(words: list[str], wording: list) -> bool:
    if wording[0] == ONE:
        return len(words) == 1 and words[0] in wording[1]
    return all(any(w in group for w in words) for group in wording)


def map_headers(headers: list[str], sample: list[dict] | None = None) -> dict[str, tuple[str, float]]:
    """{field: (header, confidence)}: by wording, else by similarity to one; a sample of values that look like the field's kind adds to it.

    Fields are taken in the order of WORDINGS and headers in the given order; a header serves one field.
    """
    found: dict[str, tuple[str, float]] = {}
    used: set[str] = set()
    for exact in (True, False):
        for field, wordings in WORDINGS.items():
            if field in found:
                continue
            best = None
            for h in headers:
                if h in used:
                    continue
                words = header_words(h)
                if exact and any(_fits(words, w) for w in wordings):
                    best = (h, EXACT)
                    break
                if not exact:
                    likeness = difflib.SequenceMatcher(None, " ".join(words), field.replace("_", " ")).ratio()
                    if likeness >= 0.65 and (best is None or likeness * NEAR > best[1]):
                        best = (h, likeness * NEAR)
            if best:
                found[field] = best
                used.add(best[0])
    if sample:
        for field, (h, sure) in found.items():
            values = [str(r[h]).strip() for r in sample if r.get(h) not in (None, "")]
            looks = {"decimal": r"^\(?-?[$€£₹]?\s*-?[\d.,]+\)?$", "date": r"^\d{1,4}[-/. ]\w{1,9}[-/. ,]+\d{1,4}"}.get(FIELDS[field])
            share = sum(bool(re.match(looks, v)) for v in values) / len(values) if looks and values else 0
            if share >= (0.8 if FIELDS[field] == "decimal" else 0.6):
                found[field] = (h, min(1.0, sure + TYPED))
    return found


def map_template(headers: list[str], template: str) -> dict[str, tuple[str, float]]:
    """{field: (header, confidence)} by a system's export headers: equal without case, else similar by .75 or more."""
    lower = {h.strip().lower(): h for h in headers}
    out = {}
    for field, wanted in TEMPLATES[template].items():
        if h := lower.get(wanted.lower()):
            out[field] = (h, 1.0)
        elif near := difflib.get_close_matches(wanted.lower(), list(lower), 1, 0.75):
            out[field] = (lower[near[0]], difflib.SequenceMatcher(None, wanted.lower(), near[0]).ratio())
    return out


def unmapped(headers: list[str], mapping: dict[str, tuple[str, float]]) -> list[str]:
    taken = {h for h, _ in mapping.values()}
    return [h for h in headers if h not in taken]


def apply_mapping(df: DataFrame, mapping: dict[str, tuple[str, float]]) -> DataFrame:
    """The mapped columns under their field names and kinds; unreadable values are null. Without a required field it is an error."""
    if missing := [f for f in REQUIRED if f not in mapping]:
        raise ValueError(f"no column for: {', '.join(missing)}")
    cast = {"string": lambda c: F.nullif(F.trim(c.cast("string")), F.lit("")), "date": lambda c: parse_date(c.cast("string")), "decimal": parse_amount}
    return df.select(*[cast[FIELDS[f]](F.col(f"`{h}`")).alias(f) for f, (h, _) in mapping.items()])


def load_invoices(spark, path: str, template: str | None = None) -> DataFrame:
    """A file of invoices as typed rows: read as text, headers mapped by template or wording, then cast; invoice_id is the number if absent."""
    from ledgersift.sources.files import load

    df = load(spark, path)
    mapping = map_template(df.columns, template) if template else map_headers(df.columns, [r.asDict() for r in df.limit(20).collect()])
    return apply_mapping(df, mapping).withColumn("invoice_id", F.col("invoice_number"))
