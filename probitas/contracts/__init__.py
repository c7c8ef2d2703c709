"""Data contracts: declared columns, types and checks, compiled to checks of a suite."""

from .legacy import Contract
from .odcs import OdcsContract
from .types import ContractValidationError, ContractWarning, SchemaValidationError

__all__ = ["Contract", "ContractValidationError", "ContractWarning", "OdcsContract", "SchemaValidationError"]
