"""Country inference from affiliation strings. Patterns are ordered: the first that fits counts."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names (lower case) and codes, in order; a parameter of the functions.
NAMES = (
    ("spain", "ES"), ("germany", "DE"), ("india", "IN"), ("france", "FR"), ("italy", "IT"), ("united kingdom", "GB"), ("uk", "GB"), ("usa", "US"),
    ("united states of america", "US"), ("united states", "US"), ("england", "GB"), ("scotland", "GB"), ("wales", "GB"), ("northern ireland", "GB"), ("great britain", "GB"),
    ("austria", "AT"), ("belgium", "BE"), ("bulgaria", "BG"), ("croatia", "HR"), ("cyprus", "CY"), ("czech republic", "CZ"), ("czechia", "CZ"), ("denmark", "DK"), ("estonia", "EE"),
    ("finland", "FI"), ("greece", "GR"), ("hungary", "HU"), ("ireland", "IE"), ("latvia", "LV"), ("lithuania", "LT"), ("luxembourg", "LU"), ("malta", "MT"), ("the netherlands", "NL"),
    ("netherlands", "NL"), ("poland", "PL"), ("portugal", "PT"), ("romania", "RO"), ("slovakia", "SK"), ("slovenia", "SI"), ("sweden", "SE"), ("norway", "NO"), ("switzerland", "CH"),
    ("turkey", "TR"), ("russia", "RU"), ("ukraine", "UA"), ("serbia", "RS"), ("israel", "IL"), ("egypt", "EG"), ("south africa", "ZA"), ("canada", "CA"), ("mexico", "MX"),
    ("brazil", "BR"), ("argentina", "AR"), ("chile", "CL"), ("colombia", "CO"), ("china", "CN"), ("hong kong", "HK"), ("taiwan", "TW"), ("japan", "JP"), ("south korea", "KR"),
    ("singapore", "SG"), ("australia", "AU"), ("new zealand", "NZ"), ("iran", "IR"), ("saudi arabia", "SA"), ("united arab emirates", "AE"), ("pakistan", "PK"), ("vietnam", "VN"),
)
#: Other forms of names, and domain suffixes that differ from their country's code.
ALIASES = (("u s a", "US"), ("u k", "GB"), ("p r china", "CN"), ("peoples republic of china", "CN"), ("republic of korea", "KR"), ("korea", "KR"), ("russian federation", "RU"), ("holland", "NL"), ("uae", "AE"), ("viet nam", "VN"))
SUFFIXES = (("ac.uk", "GB"), ("uk", "GB"), ("edu", "US"), ("gov", "US"), ("mil", "US"))
#: Parts of institutions' names that tell the country; a parameter as well.
HINTS = (("university of oxford", "GB"), ("imperial college", "GB"), ("max planck", "DE"), ("fraunhofer", "DE"), ("cnrs", "FR"), ("inria", "FR"), ("csic", "ES"), ("politecnico di", "IT"), ("eth zurich", "CH"), ("stanford", "US"), ("carnegie mellon", "US"), ("tsinghua", "CN"))


def _lookup(x: Column, names) -> Column:
    """The code of x by one map, whatever the number of names."""
    return F.try_element_at(F.from_json(F.lit(json.dumps(dict(reversed(names)))), "map<string,string>"), x)


def infer(text: Column, names=NAMES, least: int = 4, strict: bool = False) -> Column:
    """A literal code, else the last comma part that is a name, else the first name longer than `least` characters
    found in it: anywhere, or with `strict` only between word boundaries. For a few names and short texts, as within a
    nested value; `operators.gazetteer` joins texts with a dictionary."""
    clean = F.lower(F.trim(text))
    code = F.when(clean.rlike("^[a-z]{2}$"), F.upper(clean))
    parts = F.transform(F.reverse(F.split(clean, ",")), lambda p: _lookup(F.trim(p), names))
    part = F.get(F.filter(parts, lambda p: p.isNotNull()), F.lit(0))
    longer = F.array(*[F.lit(n) for n, _ in names if len(n) > least])
    inside = (lambda n: F.regexp_like(clean, F.concat(F.lit(r"\b"), n, F.lit(r"\b")))) if strict else (lambda n: F.contains(clean, n))
    sub = _lookup(F.get(F.filter(longer, inside), F.lit(0)), names)
    return F.coalesce(_lookup(clean, names), part, code, sub)
