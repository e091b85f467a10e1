"""Credentials that are read where they are used: a job's plan carries the name of a variable, not its value."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class Secret:
    """A token, or the first of some environment variables that is set. Only the latter can be written into a file."""

    variables: tuple[str, ...] = ()
    token: str | None = None
    strict: bool = True

    @classmethod
    def from_env(cls, variables: str | Sequence[str], strict: bool = True) -> Secret:
        names = (variables,) if isinstance(variables, str) else tuple(variables)
        if not names:
            raise ValueError("a secret needs a variable")
        return cls(names, None, strict)

    @classmethod
    def from_token(cls, token: str) -> Secret:
        if not token:
            raise ValueError("a token can't be empty")
        return cls((), token)

    def resolve(self) -> str | None:
        """The value; with strict, a variable must be set. Executors need the variables in their own environment."""
        if self.token is not None:
            return self.token
        found = next((os.environ[v] for v in self.variables if v in os.environ), None)
        if found is None and self.strict:
            raise ValueError(f"none of the variables {self.variables} is set")
        return found

    def to_dict(self) -> dict:
        if self.token is not None:
            raise ValueError("a token is not written into files; name an environment variable")
        return {"type": "env_var", "env_vars": list(self.variables), "strict": self.strict}

    @classmethod
    def from_dict(cls, spec: dict) -> Secret:
        if spec.get("type") != "env_var":
            raise ValueError(f"unknown kind of secret {spec.get('type')!r}")
        return cls.from_env(spec["env_vars"], spec.get("strict", True))

    def __repr__(self) -> str:
        return f"Secret({', '.join(self.variables) or 'token'})"


def value_of(key: str | Secret | None) -> str:
    """A key given as text or as a secret."""
    return (key.resolve() or "") if isinstance(key, Secret) else (key or "")
