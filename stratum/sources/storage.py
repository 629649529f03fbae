"""Storage addresses and options, and durations."""

from __future__ import annotations

import re
import tempfile
import time
from pathlib import Path
from urllib.parse import parse_qsl, urlsplit

SCHEMES = {"s3": "s3a", "s3a": "s3a", "gs": "gs", "http": "http", "https": "https", "hdfs": "hdfs", "viewfs": "viewfs", "abfss": "abfss"}
_UNITS = {"s": 1, "sec": 1, "m": 60, "min": 60, "h": 3600, "hour": 3600, "d": 86400, "day": 86400, "w": 604800, "week": 604800}


def resolve_uri(uri: str, create: bool = False) -> str:
    """The folder, as Spark reads it, of memory:// (a new temporary one, for local mode alone: no other machine sees it), a local
    path, file:// or a store that Hadoop knows."""
    parts = urlsplit(uri)
    if parts.scheme == "memory":
        return "file://" + tempfile.mkdtemp(prefix="stratum-memory-")
    if parts.scheme in ("", "file"):
        path = Path(parts.path if parts.scheme else uri).absolute()
        if create:
            path.mkdir(parents=True, exist_ok=True)
        if not path.is_dir():
            raise FileNotFoundError(f"no such folder: {path}")
        return f"file://{path}"
    if parts.scheme not in SCHEMES:
        raise ValueError(f"unknown storage scheme: {parts.scheme}")
    return f"{SCHEMES[parts.scheme]}://{parts.netloc}{parts.path}"


# fixed values: names of options
DEFAULTS = {"timeout": "10min"}
ALIASES = {"google_application_credentials": "google_service_account_path"}
SKIP = {"s3": {"aws_skip_signature", "skip_signature"}, "gs": {"google_skip_signature", "skip_signature"}}
CREDENTIALS = {
    "s3": {"aws_access_key_id", "access_key_id"},
    "gs": {
        "google_service_account", "service_account", "google_service_account_path", "service_account_path", "google_service_account_key",
        "service_account_key", "google_bearer_token", "bearer_token", "application_credentials",
    },
}
SETTINGS = {
    "access_key_id": "fs.s3a.access.key", "secret_access_key": "fs.s3a.secret.key", "session_token": "fs.s3a.session.token", "endpoint": "fs.s3a.endpoint",
    "region": "fs.s3a.endpoint.region", "google_service_account_path": "google.cloud.auth.service.account.json.keyfile",
}
TRUE = {"1", "true", "on", "yes", "y"}


def store_options(uri: str, environment: dict[str, str], defaults: dict[str, str] | None = None) -> dict[str, str]:
    """Options of a store: defaults, overridden by the address's query, overridden by the environment; empty ones go.

    Of the environment AWS_ variables count, under their names in lower case, and the two that have a meaning here; the
    conventional name of Google's credentials stands for the path of a service account.
    """
    known = {k: k.lower() for k in environment if k.startswith("AWS_") or k in ("GOOGLE_APPLICATION_CREDENTIALS", "USE_AMBIENT_CREDS")}
    query = {k.lower(): v for k, v in parse_qsl(urlsplit(uri).query)}
    own = {lower: environment[k] for k, lower in known.items()}
    merged = {k: v for part in (DEFAULTS if defaults is None else defaults, query, own) for k, v in part.items() if v}
    return merged | {new: merged[old] for old, new in ALIASES.items() if old in merged}


def check_credentials(uri: str, options: dict[str, str]) -> None:
    """PermissionError unless a cloud store's credentials are given, or waived, by name: machines are never asked for theirs."""
    parts = urlsplit(uri)
    host = parts.hostname or ""
    amazon = parts.scheme == "https" and host.endswith(("amazonaws.com", "r2.cloudflarestorage.com"))
    scheme = "s3" if parts.scheme in ("s3", "s3a") or amazon else parts.scheme
    if scheme not in CREDENTIALS or options.get("use_ambient_creds", "").strip().lower() in TRUE:
        return
    waived = any(options.get(k, "").strip().lower() in TRUE for k in SKIP[scheme])
    if not waived and not CREDENTIALS[scheme] & options.keys():
        raise PermissionError(f"no credentials for {scheme}: name them in the address or the environment, or set skip_signature or use_ambient_creds")


def hadoop_settings(options: dict[str, str]) -> dict[str, str]:
    """Hadoop's settings for options, with or without the provider's prefix."""
    found = {SETTINGS[k.removeprefix("aws_")]: v for k, v in options.items() if k.removeprefix("aws_") in SETTINGS}
    if any(options.get(k, "").strip().lower() in TRUE for k in SKIP["s3"]):
        found["fs.s3a.aws.credentials.provider"] = "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider"
    return found


def retried(run, transient, *, base: float = 1.0, cap: float = 60.0, most: int = 10, wait=time.sleep):
    """run(), tried again after each error that transient(error) holds to be one: delays double from `base` up to `cap`
    seconds, `most` of them at most; other errors are raised at once."""
    for attempt in range(most + 1):
        try:
            return run()
        except Exception as error:
            if attempt == most or not transient(error):
                raise
            wait(min(base * 2**attempt, cap))


def parse_duration(text: str) -> int:
    """Seconds of '1h', '1day 2h', '7days'; ValueError otherwise."""
    parts = re.findall(r"(\d+)\s*([a-z]+)", text.strip())
    if not parts or re.sub(r"(\d+)\s*([a-z]+)\s*", "", text.strip()):
        raise ValueError(f"not a duration: {text!r}")
    units = [_UNITS.get(u) or _UNITS.get(u.removesuffix("s")) for _, u in parts]
    if None in units:
        raise ValueError(f"not a duration: {text!r}")
    return sum(int(n) * u for (n, _), u in zip(parts, units))


def format_duration(seconds: int) -> str:
    """The shortest text for a duration, as checkpoints are named."""
    out = []
    for unit, size in (("day", 86400), ("h", 3600), ("m", 60), ("s", 1)):
        count, seconds = divmod(seconds, size)
        if count:
            out.append(f"{count}{unit}{'s' if unit == 'day' and count > 1 else ''}")
    return " ".join(out) or "0s"


def check_schedules(schedules: dict[str, str]) -> dict[int, int]:
    """Interval to time to live, in seconds; equal intervals spelled differently are an error."""
    out: dict[int, int] = {}
    for interval, ttl in schedules.items():
        seconds = parse_duration(interval)
        if seconds in out:
            raise ValueError(f"interval given twice: {interval}")
        out[seconds] = parse_duration(ttl)
    return out
