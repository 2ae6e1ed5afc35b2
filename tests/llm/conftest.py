import os

# numpy in Python workers shares the cores with Spark's tasks
os.environ.setdefault("OMP_NUM_THREADS", "1")
