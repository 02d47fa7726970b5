"""Numbers and colours of the text outputs: decimals exact and halves away from zero, whatever the locale."""

from __future__ import annotations

import math
import os
from collections.abc import Mapping
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

from tessera.functions.rates import MOVEMENT, RATE_EPSILON

#: Build services whose logs show colours.
BUILD_SERVICES = (
    "GITHUB_ACTIONS", "GITLAB_CI", "CIRCLECI", "BUILDKITE", "TF_BUILD", "DRONE", "APPVEYOR", "TRAVIS",
    "WOODPECKER", "FORGEJO_ACTIONS", "GITEA_ACTIONS",
)


def tenth(x: float) -> str:
    """One decimal of the exact binary value; a negative zero is shown as zero."""
    return str(Decimal(x + 0.0).quantize(Decimal("0.1"), ROUND_HALF_UP))


def short(x: float) -> str:
    """The shortest form that reads back: 80, 80.3."""
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def pct(rate: float | None, floor: bool = False) -> str:
    if rate is None:
        return "-"
    return tenth(math.floor(rate * 100 * 10 + RATE_EPSILON) / 10 if floor else rate * 100) + "%"


def signed(delta: float | None) -> str:
    return "-" if delta is None else ("+" if delta >= 0 else "") + tenth(delta * 100) + "%"


def plural(n: int, word: str) -> str:
    return f"{n} {word}" + ("" if n == 1 else "s")


def colours(env: Mapping[str, str] | None = None, redirected: bool = True) -> bool:
    """Should output be coloured: what the environment says first, then where it goes."""
    env = os.environ if env is None else env
    on = lambda k: env.get(k, "").lower() not in ("", "0", "false")
    if env.get("NO_COLOR"):
        return False
    if on("FORCE_COLOR") or on("CLICOLOR_FORCE"):
        return True
    if env.get("TERM") == "dumb" or env.get("CLICOLOR") == "0":
        return False
    return any(env.get(k) for k in BUILD_SERVICES) or not redirected


@dataclass(frozen=True)
class Pen:
    on: bool = False

    def _in(self, code: int, end: int, text: str) -> str:
        return f"\x1b[{code}m{text}\x1b[{end}m" if self.on else text

    def bold(self, text: str) -> str:
        return self._in(1, 22, text)

    def dim(self, text: str) -> str:
        return self._in(2, 22, text)

    def red(self, text: str) -> str:
        return self._in(31, 39, text)

    def green(self, text: str) -> str:
        return self._in(32, 39, text)

    def yellow(self, text: str) -> str:
        return self._in(33, 39, text)

    def cyan(self, text: str) -> str:
        return self._in(36, 39, text)

    def rate(self, text: str, rate: float | None) -> str:
        level = -1.0 if rate is None else rate
        return (self.green if level >= 0.75 else self.yellow if level >= 0.5 else self.red if level > 0 else self.dim)(text)

    def delta(self, text: str, delta: float | None) -> str:
        moved = 0.0 if delta is None else delta
        return (self.green if moved >= MOVEMENT else self.red if moved <= -MOVEMENT else self.dim)(text)
