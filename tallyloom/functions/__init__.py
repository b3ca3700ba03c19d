"""Column functions: amounts, dates, text and hashes."""

from .amounts import amount_key, locale_amount, plain_amount, signed_by_indicator, signed_difference
from .dates import flexible_date, iso_date
from .identity import occurrence_key, primary_hash, transaction_hash
from .text import context_slice, fold_header, ledger_text, mask, normalize_description, quoted_text, sanitize_prompt, sanitize_source_name

__all__ = [
    "amount_key", "context_slice", "flexible_date", "fold_header", "iso_date", "ledger_text", "locale_amount", "mask", "normalize_description",
    "occurrence_key", "plain_amount", "primary_hash", "quoted_text", "sanitize_prompt", "sanitize_source_name", "signed_by_indicator", "signed_difference", "transaction_hash",
]
