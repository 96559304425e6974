from .det import u01, u01_sql
from .text import (strip, drop_blank, id_text, combine_title_text, task_prefix_col,
                   format_instruction, chunk_shuffle, parse_grade, TASK_INSTRUCTIONS)
from .vectors import dot, l2_normalize, l2_norm
