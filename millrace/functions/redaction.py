"""Credentials in code text become references (SC21)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Secret scope; the assignments to replace; the calls to put in their place.
SCOPE = "enterprise"
WIDGET_CALL = 'dbutils.widgets.get("{name}")'
SECRET_CALL = 'dbutils.secrets.get(scope="{scope}", key="{key}")'
QUOTED_SETTING = r"""({setting}\s*=\s*)(["'])[^"']+?\2"""
NUMBER_SETTING = r"""({setting}\s*=\s*)(["']?)\d+\2"""
SECRET_OPTION = r"""(\.option\s*\(\s*"{setting}"\s*,\s*)"([^"]+)"(\s*\))"""
SECRET_SETTING = r"""({setting}\s*=\s*)"([^"]+)\""""
WIDGETS = {
    "email": [("server", QUOTED_SETTING, "Email_Server"), ("port", NUMBER_SETTING, "Email_Port")],
    "smb": [
        ("host", QUOTED_SETTING, "SMB_Host"),
        ("share", QUOTED_SETTING, "SMB_Share"),
        ("port", NUMBER_SETTING, "SMB_Port"),
    ],
    "ftp": [("host", QUOTED_SETTING, "FTP_Host"), ("port", NUMBER_SETTING, "FTP_Port")],
}
SECRETS = ("password", "user")

# Case-insensitive with Unicode classes, as the patterns above are meant.
_FLAGS = "(?iU)"


def _settings() -> dict[tuple[str, str], dict[str, str]]:
    """Calls by service for each setting and its pattern, ordered as in each service: one pass serves all services."""
    calls: dict[tuple[str, str], dict[str, str]] = {}
    last: dict[tuple[str, str], int] = {}
    for service, own in WIDGETS.items():
        for place, (setting, pattern, widget) in enumerate(own):
            calls.setdefault((setting, pattern), {})[service] = "$1" + WIDGET_CALL.format(name=widget)
            last[setting, pattern] = max(place, last.get((setting, pattern), 0))
    return {s: calls[s] for s in sorted(calls, key=last.get)}


SETTINGS = _settings()
#: Every pattern of an option holds this, in capitals.
_OPTION = ".OPTION"


def redacted(code: Column, service: str, scope: str = SCOPE) -> Column:
    """Replace the settings of one service kind, then its secrets; other kinds have secrets only."""
    return redacted_by_kind(code, F.lit(service), scope)


def redacted_by_kind(code: Column, kind: Column, scope: str = SCOPE) -> Column:
    """The service kind comes from a column. Secrets are replaced for every kind, under keys that begin with it; a
    null or empty kind gives `unknown_password` and `unknown_user`.

    A pass over a text costs as much as decoding and encoding it, so texts go through those only that can find
    something. Each pass has the text before it as a variable: the expression grows by one step for each, not twofold.
    """
    for (setting, pattern), calls in SETTINGS.items():
        call = F.coalesce(*[F.when(kind == service, F.lit(text)) for service, text in calls.items()])
        code = _where(code, lambda _: kind.isin(*calls), pattern.format(setting=setting), call)
    known = F.coalesce(F.nullif(kind, F.lit("")), F.lit("unknown"))
    # A kind is plain text also where it holds signs that mean something in a replacement.
    plain = F.replace(F.replace(known, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    for setting in SECRETS:
        before, after = SECRET_CALL.format(scope=scope, key=f"\0_{setting}").split("\0")
        call = F.concat(F.lit("$1" + before), plain, F.lit(after))
        code = _where(code, lambda text: F.upper(text).contains(_OPTION), SECRET_OPTION.format(setting=setting), F.concat(call, F.lit("$3")))
        code = F.regexp_replace(code, F.lit(_FLAGS + SECRET_SETTING.format(setting=setting)), call)
    return code


def _where(code: Column, applies: Callable[[Column], Column], pattern: str, call: Column) -> Column:
    def step(text: Column) -> Column:
        return F.when(applies(text), F.regexp_replace(text, F.lit(_FLAGS + pattern), call)).otherwise(text)

    return F.transform(F.array(code), step)[0]
