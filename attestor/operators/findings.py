"""What must not be in a public tree: findings by path and by content, as arrays of reasons."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path segments, suffixes and patterns that must not be public. RE2 has no look-behind, so two patterns begin with a group instead.
FORBIDDEN = [".artifacts", "checkpoints", "data", "demo_runtime", "logs", "masks", "raw_receipt", "raw_receipts", "receipts", "runs", "tmp", "uploads", "weights"]
SCRATCH = r"(?i)^(?:\.dg-[^/]+|\.pt[^/]*|\.pytest(?:[-_].*)?|\.task[^/]*|\.p7[^/]*)$"
WEIGHTS = [".ckpt", ".engine", ".mmap", ".onnx", ".pt", ".pth", ".safetensors"]
ARCHIVES = [".7z", ".bz2", ".docker", ".img", ".ova", ".rar", ".tar", ".tgz", ".vhd", ".vhdx", ".xz", ".zip"]
RECEIPT = r"(?i)(?:^|[._-])(?:raw[._-]?)?receipts?(?:$|[._-])"
TUNNEL = r"""(?i)https?://[^\s"'<>]*(trycloudflare\.com|cloudflareaccess\.com|ngrok(\.io|\.com))"""
HOST = r"(?i)(^|[^A-Za-z0-9_-])[A-Za-z0-9-]+\.(trycloudflare\.com|cloudflareaccess\.com|ngrok\.io|ngrok\.com)\b"
PRIVATE = r"""(^|[^A-Za-z0-9])([A-Za-z]:[\\/][A-Za-z0-9_. -]+|\\\\[A-Za-z0-9_.-]+[\\/][^\s"'<>]+|(/?home|/(users|Users|mnt|root|workspaces))[\\/][A-Za-z0-9_.-]+|/(opt|var)[\\/][A-Za-z0-9_.-]+)"""
SECRET = r"(?im)(-----BEGIN (RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----|ghp_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|sk-[A-Za-z0-9]{20,}|\b(AWS_SECRET_ACCESS_KEY|CLOUDFLARE_API_TOKEN)\s*=\s*[^\s]+)"


def _reasons(*rules: tuple[Column, str]) -> Column:
    return F.filter(F.array(*(F.when(F.coalesce(hit, F.lit(False)), reason) for hit, reason in rules)), lambda x: x.isNotNull())


def path_findings(path: Column) -> Column:
    """Reasons why a path must not be public; any case, either slash. A registry of evidence below demo/data may be."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    parts = F.split(p, "/")
    name = F.element_at(parts, -1)
    # all suffixes of the name: what follows each point but one that it begins with
    suffixes = F.transform(F.filter(F.split(F.regexp_replace(name, r"^\.+", ""), r"\."), lambda x, i: i > 0), lambda x: F.concat(F.lit("."), x))
    registry = p.startswith("demo/data/") & p.endswith("evidence_registry.json")
    listed = lambda values: F.array(*map(F.lit, values))
    return _reasons(
        (F.exists(parts, lambda x: x.isin(FORBIDDEN) & ~((x == "data") & registry)), "forbidden path segment"),
        (F.exists(parts, lambda x: x.rlike(SCRATCH)), "scratch path"),
        (F.arrays_overlap(suffixes, listed(WEIGHTS)), "model weight"),
        (F.arrays_overlap(suffixes, listed(ARCHIVES)), "binary archive"),
        (F.coalesce(F.try_element_at(suffixes, F.lit(-1)) == ".log", F.lit(False)) | name.startswith("cloudflared"), "runtime log"),
        (name.rlike(RECEIPT) | p.contains("raw_receipt"), "raw receipt"),
    )


def content_findings(text: Column, most_bytes: int) -> Column:
    """Reasons why a text must not be public. Plain searches come first: few texts hold what a pattern can't do without."""
    low = F.lower(text)
    holds = lambda *parts: reduce(or_, map(low.contains, parts))
    tunnel = holds("trycloudflare.com", "cloudflareaccess.com", "ngrok")
    return _reasons(
        (tunnel & text.rlike(TUNNEL), "tunnel URL"),
        (tunnel & text.rlike(HOST), "tunnel host"),
        ((text.contains("/") | text.contains("\\")) & text.rlike(PRIVATE), "private absolute path"),
        (holds("private key", "ghp_", "github_pat_", "sk-", "aws_secret_access_key", "cloudflare_api_token") & text.rlike(SECRET), "secret-like material"),
        (F.octet_length(text) > most_bytes, "oversized"),
    )
