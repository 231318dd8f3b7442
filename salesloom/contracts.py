"""Declared table contracts: names, junk columns, types and missing-value tokens."""

from __future__ import annotations

import re

# Texts that mean "missing" in the input files.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Export artefacts without content.
JUNK_COLUMNS = {
    "sales": ["Unnamed: 22", "index"],
    "international": ["index"],
    "inventory": ["index"],
    "expenses": ["index"],
    "warehouse": ["index"],
    "catalogue": ["index"],
}

# The ledger holds two lists side by side and is named by position.
LEDGER_COLUMNS = [
    "index", "Income_Particular", "Income_Amount", "Expense_Particular", "Expense_Amount",
]

# Columns that a table cannot do without.
REQUIRED = {
    "sales": ["order_id", "date", "amount"],
    "inventory": ["sku_code", "stock"],
}

# Target type per canonical column; columns not listed stay text.
TYPES = {
    "sales": {
        "date": "timestamp",
        "amount": "number",
        "qty": "number",
        "b2b": "boolean",
        "ship_postal_code": "integer",
    },
    "inventory": {"stock": "number"},
    "expenses": {"income_amount": "number", "expense_amount": "number"},
}


def canonical_name(header: str) -> str:
    """``"ship-state "`` → ``ship_state``, ``"Design No."`` → ``design_no``."""
    return re.sub(r"[^0-9a-z]+", "_", header.strip().lower()).strip("_")
