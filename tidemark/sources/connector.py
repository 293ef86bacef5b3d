"""Signing in to a drive, on the driver only; nothing of it enters a plan.

The client library isn't part of this package: ``make_client(email, password,
china=...)`` makes one. The password is always None, so the client takes it from
the system's keyring.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from typing import Any

#: The environment variables that name the account and the regional service, unless others are given.
EMAIL_VARIABLE, CHINA_VARIABLE = "ICLOUD_EMAIL", "ICLOUD_CHINA"


def account(email: str | None = None, variable: str = EMAIL_VARIABLE) -> str:
    """The given account or the environment's; ValueError if there is none."""
    found = (email or os.environ.get(variable) or "").strip()
    if not found:
        raise ValueError(f"an account is needed: pass it or set {variable}")
    return found


def sign_in(make_client: Callable[..., Any], email: str | None = None, ask: Callable[[str], str] = input, hooks: Any = None, email_variable: str = EMAIL_VARIABLE, region_variable: str = CHINA_VARIABLE) -> Any:
    """A client that is signed in, with a second factor or step where it asks for one; errors are RuntimeErrors with their cause.

    After a second factor the session is made a trusted one; where that fails
    there is a warning only.
    """
    who = account(email, email_variable)
    try:
        client = make_client(who, None, china=os.environ.get(region_variable, "").lower() == "true")
        if getattr(client, "requires_2fa", False):
            if not client.validate_2fa_code(ask("Code: ")):
                raise RuntimeError("the code was not accepted")
            if not getattr(client, "is_trusted_session", True) and not client.trust_session():
                print("Warning: the session is not trusted.")
        elif getattr(client, "requires_2sa", False):
            devices = client.trusted_devices
            if not devices:
                raise RuntimeError("there is no trusted device")
            for i, d in enumerate(devices):
                print(i, d.get("deviceName") or d.get("phoneNumber"))
            device = devices[int(ask("Device: ") or 0)]
            if not client.send_verification_code(device) or not client.validate_verification_code(device, ask("Code: ")):
                raise RuntimeError("the device was not verified")
    except Exception as e:
        raise RuntimeError(f"signing in failed: {e}") from e
    if hooks is not None:
        hooks.dispatch("on_authenticated", client)
    return client
