"""Importing the query modules fills the catalogue."""

from . import q_company, q_matching, q_pages, q_postings, q_register, q_reports, q_resolve, q_search, q_sources, q_streaming  # noqa: F401
from .catalog import QUERIES  # noqa: F401
