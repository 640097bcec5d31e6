"""Signed tokens (HS256) that carry a permission: read, write or admin."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json

from tessella.errors import InvalidArgument

PERMISSIONS = ("read", "write", "admin")


def _pack(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def _unpack(text: str) -> bytes:
    return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))


def _mark(text: str, secret: bytes) -> str:
    return _pack(hmac.new(secret, text.encode(), hashlib.sha256).digest())


def issue(subject: str, permission: str, secret: bytes) -> str:
    if permission not in PERMISSIONS:
        raise InvalidArgument(f"no permission {permission}")
    parts = [_pack(json.dumps(x, separators=(",", ":")).encode()) for x in ({"alg": "HS256", "typ": "JWT"}, {"sub": subject, "role": permission})]
    return ".".join([*parts, _mark(".".join(parts), secret)])


def verify(token: str, secret: bytes) -> dict:
    """The claims of a token; its expiry is not looked at."""
    try:
        head, body, mark = token.split(".")
        if json.loads(_unpack(head)).get("alg") != "HS256" or not hmac.compare_digest(mark, _mark(f"{head}.{body}", secret)):
            raise ValueError
        claims = json.loads(_unpack(body))
    except ValueError:
        raise InvalidArgument("the token is not valid") from None
    if claims.get("role") not in PERMISSIONS:
        raise InvalidArgument("the token has no permission")
    return claims


def allows(claims: dict, wanted: str) -> bool:
    """Each permission has those before it."""
    return PERMISSIONS.index(claims["role"]) >= PERMISSIONS.index(wanted)
