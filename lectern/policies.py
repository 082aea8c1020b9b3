"""Policy objects and the fixed limits that decide results."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class ChunkPolicy:
    """Limits and separators for packing pieces into chunks."""

    max_chars: int = 900
    max_tokens: int = 160
    spacing: str = " "
    list_separator: str = ". "

    def halved(self) -> ChunkPolicy:
        return replace(self, max_chars=max(1, self.max_chars // 2), max_tokens=max(1, self.max_tokens // 2))


@dataclass(frozen=True)
class ReadPolicy:
    """How markdown blocks are voiced."""

    include_code: bool = False
    announce_headings: bool = False
    list_prefix: str = "none"  # none | bullet | numbered item


PLAIN_READING = ReadPolicy()
EXPRESSIVE_READING = ReadPolicy(announce_headings=True, list_prefix="bullet")
DEFAULT_CHUNKS = ChunkPolicy()
PREEMPTIVE_CHUNKS = ChunkPolicy(max_chars=420, max_tokens=85)


# Results must agree with these numbers.
MIN_AUDIO_SECONDS = 0.05
TOKENS_PER_SECOND = 2.6
DURATION_SAFETY = 0.25
MIN_RATE, MAX_RATE = 0.5, 2.5
SYNTH_ATTEMPTS, SYNTH_BACKOFF_MS, MAX_SPLIT_DEPTH = 3, 180, 3
PLAYBACK_RETRIES, PLAYBACK_BACKOFF_MS = 2, 200
MIN_AUDIO_BYTES = 64
MIN_RMS = 1e-4
MIN_COMPLETION_RATIO = 0.6
WASM_FAILURE_LIMIT = 3
LOOKAHEAD = 2
RECENT_ENTRIES = 20
MAX_REDIRECTS = 5
MAX_RESPONSE_BYTES = 2 * 1024 * 1024
FETCH_TIMEOUT_MS = 8000
MIN_DEVICE_MEMORY_GB = 4.0
