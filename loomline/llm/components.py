"""Connected components, shared with the transcript operators."""

from loomline.operators.components import components  # noqa: F401
