"""Identity scalars built on the 32-bit hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import kernels as K
from lectern.functions import text as T


def segment_id(position: Column, text: Column) -> Column:
    return F.concat(F.lit("seg_"), K.fnv1a32(F.concat(position.cast("string"), F.lit(":"), text)))


def cache_key(provider: Column, runtime: Column, dtype: Column, segment: Column, text: Column, voice: Column, rate: Column) -> Column:
    """Key of a synthesis result: who speaks it, which segment, and a cheap text fingerprint."""
    trimmed = T.js_trim(text)
    fingerprint = F.concat_ws(
        ":", T.utf16_length(trimmed).cast("string"), F.left(trimmed, F.lit(24)), F.right(trimmed, F.lit(24))
    )
    voice = F.coalesce(voice, F.lit(""))
    rate_text = F.coalesce(T.number_text(rate), F.lit(""))
    return F.concat_ws("|", provider, runtime, dtype, segment, fingerprint, voice, rate_text)
