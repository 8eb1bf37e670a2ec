"""Kerbside analytics on Spark: the names a user needs to go from frames or detections to placed cars."""

from .operators.motion import odometry, scene_motion, similarity_fit, verify_revisits
from .operators.place import block_faces, geolocate, gps_track, position_at
from .operators.spatial import judge, match, overstay, presence
from .operators.survey import survey, work_cells
from .operators.tracking import bootstrap_interval, track_parked
from .progress import watched
from .sources.documents import write_boxes, write_faces, write_overlay, write_sightings_csv
from .sources.files import detect, read_frames, straight_track, tile_boxes, vehicles


def count_parked(frames, detector, schema: str, **options):
    """Parked cars of a table of frames, in order along each street: a user's detector, then track_parked."""
    return track_parked(detect(frames, detector, schema), **options).orderBy("segment", "along_m", "side")


__all__ = [
    "block_faces", "bootstrap_interval", "count_parked", "detect", "geolocate", "gps_track", "judge", "match", "odometry", "overstay", "position_at", "presence",
    "read_frames", "scene_motion", "similarity_fit", "straight_track", "survey", "tile_boxes", "track_parked", "vehicles", "verify_revisits", "watched",
    "work_cells", "write_boxes", "write_faces", "write_overlay", "write_sightings_csv",
]
