"""Schemas of the logical tables.  Times are BIGINT nanoseconds: a TIMESTAMP would cut them to microseconds."""

from __future__ import annotations

SENSOR_READINGS = "sensor_id string, kind string, timestamp_ns bigint, sector string, distance_m double, valid boolean"
BOX = "struct<x1: double, y1: double, x2: double, y2: double>"
DETECTION = f"struct<class_id: int, class_name: string, confidence: double, box: {BOX}, sector: string>"
FRAMES = (
    "frame_id bigint, captured_ns bigint, model_started_ns bigint, model_finished_ns bigint, width int, height int, "
    f"backend string, model_id string, source string, stage_ms map<string, double>, detections array<{DETECTION}>"
)
DECISIONS = (
    "timestamp_ns bigint, level string, sectors array<string>, nearest_distance_m double, semantic_labels array<string>, "
    "range_triggered boolean, fresh_range_sensor_count int, reason string"
)
HAPTIC_COMMANDS = "timestamp_ns bigint, level string, sectors array<string>, intensity double, pulse_period_ms int, reason string"
BENCHMARK_FRAMES = "frame_id bigint, payload string, source string, source_type string, captured_ns bigint, capture_started_ns bigint, available_ns bigint, dropped_since_last int"
OBSERVATIONS = "iteration int, repetition int, source string, model_call_ms double, frame_age_at_model_finish_ms double, detection_count int, stage_ms map<string, double>"
POWER_SAMPLES = "timestamp_ns bigint, power_w double"
MATRIX = "id string, model string, model_key string, runtime string, imgsz int, precision string, source string, threads int"
REGISTRY = "model_key string, path string, sha256 string, map50 double, map50_95 double, recall double"
CLASS_MAP = "source string, class_id int, source_class string, target_class string"
LABEL_LINES = "source string, split string, stem string, line_no int, text string"
AUDIT_RECORDS = "split string, path string, sha256 string, dhash64 bigint"
NEAR_PAIRS = "hamming_distance int, left_split string, left_path string, right_split string, right_path string"
CHECKPOINTS = "path string, completed_epoch int, optimizer_present boolean, names array<string>, sha256 string"
FILE_MANIFEST = "path string, bytes bigint, sha256 string"
MOUNT_PROFILE = (
    "profile_id string, mount_zone string, optical_axis string, distance_below_handle_mm double, max_distance_below_handle_mm double, "
    "nominal_pitch_down_deg double, pitch_tolerance_deg double, nominal_roll_deg double, roll_tolerance_deg double, "
    "hand_occlusion_check_required boolean, intrinsic_calibration_required boolean, extrinsic_calibration_required boolean, hardware_verified boolean"
)

SECTORS = ("left", "center", "right", "unknown")
SENSOR_KINDS = ("tof", "ultrasonic", "imu")
LEVELS = ("clear", "warning", "critical", "sensor_fault")
SPLIT_RANK = {"train": 1, "val": 2, "test": 3}
