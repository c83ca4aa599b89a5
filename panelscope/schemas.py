"""Declared schemas of the facts, dimensions and marts, with the columns of their folders.

The column names are fixed values.
"""

from __future__ import annotations

from pyspark.sql import types as T

_STRING = T.StringType()
_TIME = T.TimestampNTZType()
_INT = T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


INSPECTION = _struct(
    facility_code=_STRING,
    inspection_end_ymdhms=_TIME,
    defect_seq_no=_INT,
    product_id=_STRING,
    panel_id=_STRING,
    process_code=_STRING,
    process_term_name_s=_STRING,
    process_group_code=_STRING,
    lot_id=_STRING,
    equipment_group_id=_STRING,
    equipment_id=_STRING,
    equipment_term_name_s=_STRING,
    part_no_term_name=_STRING,
    production_type_code=_STRING,
    model_code=_STRING,
    final_flag=_STRING,
    def_latest_judgement_code=_STRING,
    def_latest_summary_defect_term_name_s=_STRING,
    panel_addr=_STRING,
    panel_x=_STRING,
    panel_y=_STRING,
    year=_INT,
    month=_INT,
    day=_INT,
    def_pnt_x=T.FloatType(),
    def_pnt_y=T.FloatType(),
    def_pnt_g=T.LongType(),
    def_pnt_d=T.LongType(),
    def_size=T.FloatType(),
    defect_name=_STRING,
)

HISTORY = _struct(
    process_code=_STRING,
    move_in_ymdhms=_TIME,
    equipment_id=_STRING,
    data_insert_ymdhms=_TIME,
    data_update_ymdhms=_TIME,
    receive_ymdhms=_TIME,
    etl_insert_update_ymdhms=_TIME,
    factory_code=_STRING,
    product_type_code=_STRING,
    product_id=_STRING,
    original_product_id=_STRING,
    apd_seq_no=_INT,
    apd_data_id=_STRING,
    equipment_hierarchy_type_code=_STRING,
    equipment_line_id=_STRING,
    equipment_machine_id=_STRING,
    equipment_unit_id=_STRING,
    equipment_path_id=_STRING,
    delete_flag=_STRING,
    equip_timekey_ymdhms=_TIME,
    pre_equipment_status_code=_STRING,
    equipment_status_code=_STRING,
    lot_id=_STRING,
    facility_code=_STRING,
    model_code=_STRING,
    bucket_id=_STRING,
    load_day=_STRING,
)

GLASS_STATS = _struct(
    facility_code=_STRING,
    stat_date=T.DateType(),
    product_id=_STRING,
    defect_name=_STRING,
    model_code=_STRING,
    lot_id=_STRING,
    work_time=_TIME,
    inspection_time=_TIME,
    process_code=_STRING,
    equipment_line_id=_STRING,
    equipment_machine_id=_STRING,
    equipment_path_id=_STRING,
    total_defects=T.LongType(),
    panel_map=T.ArrayType(T.LongType()),
    panel_addrs=T.ArrayType(_STRING),
    created_at=T.TimestampType(),
)

MODEL_LAYOUT = _struct(model_code=_STRING, ref_panels=T.ArrayType(_STRING), updated_at=T.TimestampType())

GRID = _struct(model_code=_STRING, x_list=T.ArrayType(_STRING), y_list=T.ArrayType(_STRING))
