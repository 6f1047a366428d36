"""All queries of the sky model and their SQL."""

from . import archives, catalogs, images, relations, skyviews

_PARTS = (images, relations, skyviews, archives, catalogs)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: text for part in _PARTS for name, text in part.SQL.items()}
