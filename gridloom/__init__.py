"""Images as tables of pixels, analysed with Spark."""

from .operators import filters as ndfilters
from .operators import fourier as ndfourier
from .operators import interp as ndinterp
from .operators import measure as ndmeasure
from .operators import morph as ndmorph
from .operators.label import label, structure
from .plans.blocks import Blocks
from .plans.image import Image, grid
from .sources.imread import imread
from .sources.imwrite import write_frames, write_stack
from .sources.tiles import read_tiles, write_tiles

__all__ = ["Blocks", "Image", "grid", "imread", "label", "ndfilters", "ndfourier", "ndinterp", "ndmeasure", "ndmorph", "read_tiles", "structure", "write_frames", "write_stack", "write_tiles"]
