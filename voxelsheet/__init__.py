"""Volume and surface analytics as Spark plans.

Every operator is a function from DataFrames to a lazy DataFrame. Domain tables:

=============  =====================================================================
voxels         volume_id, z, y, x, v            one row per non-empty cell
bricks         volume_id, bz, by, bx, data      little-endian uint16 cubes
surface        face_id, px, py, x, y, z, nx, ny, nz
raster         face_id, px, py, mask, ink, r, g, b, texture
predictions    job, epoch, batch, region, px, py, value columns, seq and tie columns
slabs          slab, z, y, x, raw               overlapping stacks of one scan
metrics        job, epoch, batch, step, metric, value100, ts
sources        source_ord, path, type, ppm, invert_normals, box, set flags
=============  =====================================================================
"""
