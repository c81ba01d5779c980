"""Text policy as columns: secrets, normal form, accepted texts.

Secrets are found in the JVM, one regular expression per issuer. A text may as well be JSON: no pattern takes a quote or a
line end out of it, so what was valid stays valid, at any depth. Only what Spark has no function for (NFKC, case folding) is an
Arrow function.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

REDACTED = "[REDACTED]"

# What issuers publish about the looks of their credentials.
ISSUERS = {
    "aws": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github": r"\bgh[oprsu]_[0-9A-Za-z]{20,255}\b",
    "github fine-grained": r"\bgithub_pat_\w{20,255}\b",
    "google": r"\bAIza[\w-]{35}",
    "json web token": r"\beyJ[\w-]{10,}\.eyJ[\w-]{10,}\.[\w-]{10,}",
    "openai": r"\bsk-[\w-]{20,}",
    "slack": r"\bxox[a-z]-[\w-]{15,}",
    "stripe": r"\b[rs]k_(?:live|test)_[0-9A-Za-z]{16,}",
    "xai": r"\bxai-[\w-]{20,}",
}
# Names whose assigned value is a secret, and values that only hold a place.
ASSIGNED = ["access token", "api key", "client secret", "password", "refresh token"]
PLACEHOLDERS = ["your_api_key_here", "your_key_here", "paste_your_key_here", "paste_api_key_here", "example_password", "replace_this_value", "[redacted]"]

#: A PEM block up to its end, or, cut short, as far as base64 goes on (JSON writes its line ends as two characters).
PEM = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[A-Za-z0-9+/=:, \r\n-]|\\[nr])*?(?:-----END [A-Z ]{0,40}PRIVATE KEY-----|(?![A-Za-z0-9+/=:, \r\n-]|\\[nr]))"
#: What an Authorization header carries.
BEARER = r"(?i)\b(bearer +)[\w.~+/-]{20,}=*"


def _assignment() -> str:
    names = "|".join(n.replace(" ", "[ _-]?") for n in ASSIGNED)
    held = "|".join(rf"\Q{p}\E" for p in PLACEHOLDERS)
    return rf"(?i)((?:{names})\\?[\"']? *[:=] *\\?[\"']?)(?!(?:{held})(?:[.?!]|[^\w\[\]]|\z))([^\s\"'\\,;<>]{{12,}})"


def issued_free(text: Column) -> Column:
    """The text without credentials whose looks give their issuer away, in one pass."""
    return F.regexp_replace(text, F.lit("|".join(ISSUERS.values())), F.lit(REDACTED))


def secret_free(text: Column) -> Column:
    """The text with every known secret replaced."""
    keys = [(PEM, REDACTED), *[(p, REDACTED) for p in ISSUERS.values()], (BEARER, "$1" + REDACTED), (_assignment(), "$1" + REDACTED)]
    return reduce(lambda x, k: F.regexp_replace(x, F.lit(k[0]), F.lit(k[1])), keys, text)


def acceptable(text: Column, most: int = 4000) -> Column:
    """Something to read, at most so many characters, and no control character but tabs and line ends."""
    odd = text.rlike(r"[\p{Cc}\p{Cs}&&[^\t\r\n]]")
    return F.coalesce((F.length(F.trim(text)) > 0) & (F.length(text) <= most) & ~odd, F.lit(False))


def _normal(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.utf8_normalize(texts, "NFKC"), r"\p{Cf}", "")


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return _normal(pa.array(text, pa.string(), from_pandas=True)).to_pandas()


def normalised(text: Column) -> Column:
    """NFKC without format characters; plain ASCII never leaves the JVM's side of the plan's filter."""
    return F.when(text.rlike(r"\A\p{ASCII}*\z"), text).otherwise(_nfkc(text))


@F.pandas_udf(StringType())
def case_folded(text: pd.Series) -> pd.Series:
    return text.map(str.casefold, na_action="ignore")
