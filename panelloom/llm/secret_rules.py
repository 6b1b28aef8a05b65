"""What counts as a secret: patterns of tokens that carry a mark of their issuer, and three general shapes."""

from __future__ import annotations

from typing import NamedTuple


class Secret(NamedTuple):
    """A match of ``pattern`` whose ``group`` has at least ``minimum`` characters; ``folded`` ignores the case of A-Z."""

    kind: str
    pattern: str
    group: int = 0
    minimum: int = 0
    folded: bool = False


# Kinds, patterns and lengths as given, in their order; runs of hexadecimal digits are
# maximal, so a run of at least 24 is the run itself.
BASE = [
    Secret("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Secret("access", r"AKIA[A-Z0-9]+", 0, 20),
    Secret("hex", r"[0-9a-f]{24,}"),
]

# Formats that services publish for their own tokens. No look-around and no unbounded head, so any engine
# finds the same matches in linear time.
ISSUED = [
    Secret("aws-session", r"ASIA[A-Z0-9]{16}"),
    Secret("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Secret("github-fine", r"github_pat_[A-Za-z0-9_]{22,}"),
    Secret("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Secret("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Secret("slack-hook", r"hooks\.slack\.com/services/[A-Za-z0-9/]{20,}"),
    Secret("stripe", r"(sk|rk)_(live|test)_[A-Za-z0-9]{10,}"),
    Secret("google", r"AIza[A-Za-z0-9_-]{35}"),
    Secret("google-oauth", r"ya29\.[A-Za-z0-9_-]{20,}"),
    Secret("sendgrid", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}"),
    Secret("twilio", r"SK[0-9a-f]{32}"),
    Secret("npm", r"npm_[A-Za-z0-9]{36}"),
    Secret("pypi", r"pypi-[A-Za-z0-9_-]{32,}"),
    Secret("huggingface", r"hf_[A-Za-z]{34}"),
    Secret("digitalocean", r"do[opr]_v1_[0-9a-f]{64}"),
    Secret("shopify", r"shp(at|ca|pa|ss)_[0-9a-fA-F]{32}"),
    Secret("databricks", r"dapi[0-9a-f]{32}"),
    Secret("mailgun", r"key-[0-9a-f]{32}"),
    Secret("square", r"sq0(atp|csp)-[A-Za-z0-9_-]{22,}"),
    Secret("vault", r"hvs\.[A-Za-z0-9_-]{24,}"),
    Secret("grafana", r"glsa_[A-Za-z0-9]{32}_[0-9a-f]{8}"),
    Secret("age", r"AGE-SECRET-KEY-1[A-Z0-9]{58}"),
    Secret("telegram", r"[0-9]{8,10}:AA[A-Za-z0-9_-]{33}"),
    Secret("azure", r"AccountKey=[A-Za-z0-9+/]{40,}={0,2}"),
    Secret("bearer", r"bearer\x20+[a-z0-9._~+/=-]{20,}", 0, 0, True),
    Secret("web-token", r"eyJ[A-Za-z0-9_-]{8,900}\.eyJ[A-Za-z0-9_-]{8,900}\.[A-Za-z0-9_-]{8,900}"),
    Secret("private-key", r"-----BEGIN\x20[A-Z\x20]{0,24}PRIVATE\x20KEY-----"),
    Secret("url-password", r"[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._~-]{1,64}:[^\x00-\x20/:@]{3,64}@[A-Za-z0-9.-]{3,}"),
]

RULES = BASE + ISSUED
