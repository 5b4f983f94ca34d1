"""Settings of a review, and the character budget that fits a model's context window."""

from __future__ import annotations

import dataclasses
import os
from dataclasses import dataclass

from .functions.patterns import EXEMPT_PATH

VERDICTS = ("pass", "review", "block")


class ConfigError(ValueError):
    """A setting that can't work."""


def fit_max_chars(prompt_chars: int, num_ctx: int, num_predict: int, chars_per_token: float = 3.6, safety: float = 0.85) -> int:
    """Characters of a diff that fit beside the prompt and the reply."""
    tokens = num_ctx * safety - num_predict - prompt_chars / chars_per_token
    if tokens <= 0:
        raise ConfigError(f"num_ctx={num_ctx} has no room for a diff beside a prompt of {prompt_chars} characters and {num_predict} tokens of reply")
    return int(tokens * chars_per_token)


@dataclass(frozen=True)
class Config:
    block: int = 70
    review: int = 40
    max_chars: int = 16_000
    max_chunks: int = 8
    max_seconds: float = 300.0
    large_diff_chars: int = 200_000
    reduce: str = "concat"
    num_ctx: int = 4096
    num_predict: int = 768
    fail_safe: str = "review"
    fail_closed: bool = False
    request_timeout: float = 180.0
    retry_backoff: float = 2.0
    retries: int = 3
    injection_floor: int = 55
    corroborate: bool = True
    bootstrap_files: int = 60
    bootstrap_added_lines: int = 3000
    registries: tuple[str, ...] = ()
    floor_on_mode: bool = False
    chunks_before_deadline: int | None = None
    exempt_path: str = EXEMPT_PATH
    strict_paths: bool = False  # paths in quotes begin a file, too
    trim_large: bool = False  # diffs of more than large_diff_chars are reviewed with one line of context

    def __post_init__(self):
        object.__setattr__(self, "max_chunks", max(1, self.max_chunks))
        object.__setattr__(self, "retries", max(1, self.retries))
        if self.fail_safe.strip().lower() not in VERDICTS[1:]:  # "pass" would switch the fail-safe off
            object.__setattr__(self, "fail_safe", "review")

    def fitted(self, prompt_chars: int) -> Config:
        """max_chars is only ever lowered."""
        return dataclasses.replace(self, max_chars=min(self.max_chars, fit_max_chars(prompt_chars, self.num_ctx, self.num_predict)))

    @classmethod
    def from_env(cls, prefix: str = "PATCHLENS_", env=None) -> Config:
        """Fields by their upper-case names; 1, true and yes are true; registries are comma-separated."""
        env = os.environ if env is None else env
        got = {}
        for f in dataclasses.fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is None:
                continue
            if f.name == "registries":
                got[f.name] = tuple(x.strip().lower() for x in raw.split(",") if x.strip())
            elif isinstance(f.default, bool):
                got[f.name] = raw.strip().lower() in ("1", "true", "yes")
            else:
                got[f.name] = int(raw) if f.default is None else type(f.default)(raw)
        return cls(**got)


#: The larger window that continuous integration uses.
CI = Config(num_ctx=8192, request_timeout=600.0)
