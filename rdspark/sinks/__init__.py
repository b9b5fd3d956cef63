"""Writers of results and reports. Raw video is written by ``sources.rawvideo``."""
