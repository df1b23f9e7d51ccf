"""What a stream was built from, for ``TStream.tree()``; Catalyst's own plan is in ``explain``."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Node:
    """An operator with its arguments and inputs."""

    name: str
    arguments: dict = field(default_factory=dict)
    inputs: tuple[Node, ...] = ()

    @property
    def stateless(self) -> bool:
        """Row by row: no shuffle and no state."""
        return self.name in ("select", "where", "shift", "clip")

    def render(self, depth: int = 0) -> str:
        arguments = ", ".join(f"{k}={v}" for k, v in self.arguments.items())
        line = f"{'  ' * depth}{self.name}({arguments})" + (" [row by row]" if self.stateless else "")
        return "\n".join([line, *(x.render(depth + 1) for x in self.inputs)])
